"""Decontamination, lexical search and whitening against brute force, and on odd and empty tables."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from meterlight.llm import decontaminate, lexical, queries, secular, whitening
from tests.llm.conftest import ROWS, SMALL

FOLD = {c: c + 32 for c in range(65, 91)}
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def table(spark, name: str, texts: list) -> object:
    """``name`` (an id column) and ``text``, with columns the operators also use."""
    odd = ", words string, gram string, rank int, score long, `a.b` int"
    return spark.createDataFrame([(*t, "w", "g", 1, 2, 3) for t in texts], f"{name} long, text string{odd}")


def in_duckdb(sql: str, folder: str = SMALL) -> list[tuple]:
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.sql(f"create view {name} as select * from '{folder}/{name}.parquet'")
    return sorted(con.sql(sql).fetchall(), key=str)


# ---- 11: decontamination ------------------------------------------------------------------


def judged(docs: list, items: list, length: int = 10) -> list[tuple]:
    split = [(str(i) if i is not None else "", WORD.findall((t or "").translate(FOLD))) for i, t in items]
    windows: dict[tuple, set] = {}
    for name, words in split:
        n = min(length, len(words))
        for at in range(len(words) - n + 1 if n else 0):
            windows.setdefault(tuple(words[at : at + n]), set()).add(name)
    sizes = {len(w) for w in windows}
    out = []
    for id, text in docs:
        words = WORD.findall((text or "").translate(FOLD))
        hit, names = set(), set()
        for n in sizes:
            for at in range(len(words) - n + 1):
                if own := windows.get(tuple(words[at : at + n])):
                    hit.update(range(at, at + n))
                    names |= own
        digest = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
        out.append((id, len(words), len(hit), len(names), digest, bool(hit)))
    return sorted(out, key=str)


ITEMS = [
    (1, "What is the capital city of the old country beyond the seven hills? Answer now."),
    (1, "What is the capital city of the old country beyond the seven hills? Answer now."),
    (2, "what is the CAPITAL city of the old country beyond the dark sea"),
    (10, "ÄPFEL und birnen"),
    (None, "forty-two"),
    (4, "?!"),
    (5, None),
    (6, ""),
]
TEXTS = [
    (1, "Intro. What is, the capital; city of the old country: beyond THE seven hills - answer later. End"),
    (1, "Intro. What is, the capital; city of the old country: beyond THE seven hills - answer later. End"),
    (2, "the capital city of the old country beyond the"),
    (3, "Äpfel und Birnen, ÄPFEL UND BIRNEN; forty two and forty-two"),
    (None, "forty two " * 4000),
    (4, None),
    (5, ""),
    (6, "..."),
    (7, "Clean words of a text that no item has, and more of them to fill a window."),
]


def test_windows_and_hits_against_brute_force(spark):
    docs, items = table(spark, "doc_id", TEXTS), table(spark, "item_id", ITEMS)
    for length in (10, 3):
        assert rows(decontaminate.judge(docs, items, length)) == judged(TEXTS, ITEMS, length)


def test_decontamination_equals_sql_and_brute_force(spark):
    folder = "/root/testdata/sf0.01"
    got = rows(queries.op11_decontamination(spark, folder))
    assert got == in_duckdb(decontaminate.sql(), folder)
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    assert got == judged(docs, items) and any(r[-1] for r in got)


def test_a_full_hash_set_changes_nothing(spark, monkeypatch):
    """With 64 bits a word for all windows nearly every place passes the set; the join still decides."""
    docs, items = table(spark, "doc_id", TEXTS), table(spark, "item_id", ITEMS)
    monkeypatch.setattr(decontaminate, "MOST_LONGS", 1)
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", 0)
    many = [(100 + i, f"a{i} b{i} c{i}") for i in range(300)]
    wide = table(spark, "item_id", ITEMS + many)
    assert decontaminate.Windows(items).small is False
    assert rows(decontaminate.judge(docs, wide)) == judged(TEXTS, ITEMS + many)


def test_spans_and_documents_are_removed(spark):
    docs, items = table(spark, "doc_id", TEXTS), table(spark, "item_id", ITEMS)
    cut = decontaminate.remove_spans(docs, items)
    assert cut.columns == docs.columns and cut.count() == len(TEXTS)
    texts = dict((r["doc_id"], r["text"]) for r in cut.collect())
    assert texts[1] == "Intro. later. End"
    assert texts[3] == "and " and texts[None] == ""
    assert texts[4] is None and texts[7] == TEXTS[-1][1] and texts[2] == TEXTS[2][1]
    kept = decontaminate.drop_hit(docs, items)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [2, 4, 5, 6, 7]


def test_decontamination_odd_and_empty(odd, empty, spark):
    nothing = table(spark, "item_id", [])
    items = table(spark, "item_id", ITEMS)
    assert rows(decontaminate.judge(empty, items)) == []
    plain = [(r[0], r[1]) for r in ROWS]
    assert rows(decontaminate.judge(odd, items)) == judged(plain, ITEMS)
    assert rows(decontaminate.judge(odd, nothing)) == judged(plain, [])
    assert decontaminate.remove_spans(odd, nothing).columns == odd.columns
    assert decontaminate.drop_hit(empty, items).count() == 0


# ---- 12: lexical search -------------------------------------------------------------------


def ranked(docs: list, items: list, k: int = 10) -> list[tuple]:
    counted = [(id, Counter(TERM.findall((t or "").translate(FOLD)))) for id, t in docs]
    counted = [(id, c, sum(c.values())) for id, c in counted if c]
    n_docs, n_terms = len(counted), sum(n for _, _, n in counted)
    held = Counter(t for _, c, _ in counted for t in c)
    out = []
    for item, text in items:
        found = []
        for id, counts, n in counted:
            m = 10 + 90 * n * n_docs // n_terms
            score = 0
            for t in set(TERM.findall((text or "").translate(FOLD))) & set(counts):
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * held[t] + 1)))
                score += w * (1_000_000_000 * counts[t] // (1000 * counts[t] + 8 * m))
            if score > 0:
                found.append((-score, id is None, id))
        found.sort(key=lambda f: (f[0], f[1], f[2] or 0))
        out += [(item, i + 1, id, -s) for i, (s, _, id) in enumerate(found[:k])]
    return sorted(out, key=str)


def test_search_equals_sql_and_brute_force(spark):
    folder = "/root/testdata/sf0.01"
    got = rows(queries.op12_search(spark, folder))
    assert got == in_duckdb(lexical.sql(), folder)
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    assert got == ranked(docs, items)


@pytest.mark.parametrize("tiles", [(1024, 256, 2048), (3, 2, 5)])
def test_search_in_tiles_and_batches_with_ties(spark, monkeypatch, tiles):
    """Many equal scores across tiles, tasks and batches, null ids among them."""
    for name, value in zip(("TILE_DOCUMENTS", "TILE_ITEMS", "TILE_TERMS"), tiles):
        monkeypatch.setattr(lexical, name, value)
    rng = random.Random(4)
    names = [f"t{i}" for i in range(30)]
    names += ["Ä", "日本", "X1"]
    docs = [(i, " ".join(rng.choices(names, k=rng.choice([0, 1, 2, 2, 8])))) for i in range(120)]
    docs += [(7, "t1 t2"), (7, "t1 t2"), (None, "t1 t2"), (None, None), (500, ""), (501, "12 34!")]
    items = [(i % 9, " ".join(rng.choices(names, k=6))) for i in range(12)] + [(90, None), (91, "99"), (None, "t1 t1 ä")]
    got = lexical.rank_documents(table(spark, "doc_id", docs).repartition(5), table(spark, "item_id", items), 10, 20)
    assert rows(got) == ranked(docs, items)


def test_sums_of_a_tile_stay_exact():
    top = 1000 * 44  # 1000 ln(2N + 2) for any 64-bit N
    assert lexical.terms_of_tile(top) * top * lexical.TOP_IMPACT < lexical.EXACT
    assert lexical.terms_of_tile(1 << 40) * (1 << 40) * lexical.TOP_IMPACT <= max(lexical.EXACT, (1 << 40) * lexical.TOP_IMPACT)
    tf = np.array([1, 5, 1 << 40])
    for n_docs, n_terms, n in ((10, 1000, 7), (1 << 40, 1 << 50, 1 << 30)):
        m = 10 + 90 * n * n_docs // n_terms
        want = [1_000_000_000 * int(t) // (1000 * int(t) + 8 * m) for t in tf[:2]]
        assert lexical.impacts(tf[:2], np.array([n, n]), n_docs, n_terms).tolist() == want


def test_search_odd_and_empty(odd, empty, spark):
    items = table(spark, "item_id", ITEMS)
    assert rows(lexical.rank_documents(odd, items)) == ranked([(r[0], r[1]) for r in ROWS], ITEMS)
    assert rows(lexical.rank_documents(empty, items)) == []
    assert rows(lexical.rank_documents(odd, table(spark, "item_id", []))) == []


# ---- 13: whitening ------------------------------------------------------------------------


def scatter(x: np.ndarray) -> np.ndarray:
    away = x - x.mean(axis=0)
    return away.T @ away


@pytest.mark.parametrize("kind", ["normal", "low rank", "few values", "many scales", "copies", "one", "single entry"])
def test_rank_one_updates_give_the_scatter(kind):
    rng = np.random.default_rng(5)
    x = {
        "normal": rng.normal(size=(400, 24)),
        "low rank": np.floor(rng.normal(size=(200, 4)) @ rng.normal(size=(4, 16)) * 50),
        "few values": rng.integers(-1, 2, size=(300, 6)).astype(float),
        "many scales": rng.normal(size=(300, 12)) * 10.0 ** rng.integers(-4, 5, 12),
        "copies": np.repeat(rng.normal(size=(5, 8)), 20, axis=0),
        "one": np.ones((4, 3)),
        "single entry": rng.normal(size=(50, 1)),
    }[kind]
    whole, left, right = (secular.Spectrum(x.shape[1]) for _ in range(3))
    for i, row in enumerate(x):
        whole.add(row)
        (left if i % 3 else right).add(row)
    left.merge(right)
    want = scatter(x)
    size = max(1e-300, np.abs(want).max())
    for s in (whole, left):
        assert s.n == len(x) and np.allclose(s.mean, x.mean(axis=0), atol=1e-12 * max(1, np.abs(x).max()))
        assert np.abs((s.vectors * s.values) @ s.vectors.T - want).max() <= 1e-12 * size
        assert np.abs(s.vectors.T @ s.vectors - np.eye(x.shape[1])).max() < 1e-12


def test_roots_of_the_secular_equation():
    rng = np.random.default_rng(6)
    for k in (1, 2, 9, 40):
        d = np.sort(rng.normal(size=k))
        z = rng.normal(size=k) * 10.0 ** rng.integers(-6, 1, k)
        delta = secular.roots(d, z * z, 2.5)
        want = np.linalg.eigvalsh(np.diag(d) + 2.5 * np.outer(z, z))
        assert np.allclose(d[:, None] - delta, want[None, :], atol=1e-12 * max(1, np.abs(want).max()))


def test_whitening_against_a_direct_solution(spark):
    folder = "/root/testdata/sf0.01"
    source = spark.read.parquet(f"{folder}/embeddings.parquet").collect()
    fine = [r for r in source if r["embedding"] is not None and all(v is not None and math.isfinite(v) for v in r["embedding"])]
    x = {r["vec_id"]: [math.floor(256 * float(v)) for v in r["embedding"]] for r in fine}
    unique = np.array(sorted({tuple(v) for v in x.values()}), np.int64)
    n, sums = len(unique), unique.sum(axis=0)
    values, vectors = np.linalg.eigh(scatter(unique.astype(float)) / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    got = queries.op13_whitening(spark, folder).collect()
    assert len(got) == 4 * len(fine)
    by_component = {c: {} for c in range(1, 5)}
    for r in got:
        assert r["n"] == n and abs(r["identity_error"]) < 1e-10
        assert r["deviation"] == sum((n * a - int(s)) ** 2 for a, s in zip(x[r["vec_id"]], sums))
        assert math.isclose(r["explained"], values[r["component"] - 1] / values.sum(), rel_tol=1e-12)
        by_component[r["component"]][r["vec_id"]] = r["whitened"]
    for c, found in by_component.items():
        want = {i: float((np.array(v) - sums / n) @ vectors[:, c - 1] / np.sqrt(values[c - 1])) for i, v in x.items()}
        sign = np.sign(sum(found[i] * want[i] for i in want))
        assert max(abs(sign * found[i] - want[i]) for i in want) < 1e-9


def test_updates_alone_are_near_the_solution(spark):
    """The refinement polishes; the merged spectra of several tasks already hold the scatter."""
    rng = np.random.default_rng(8)
    x = rng.integers(-300, 300, size=(700, 12))
    table = spark.createDataFrame([(v.tolist(),) for v in x], "x array<long>")
    spectrum, sums = whitening.gather(table, 20)  # three levels of merging
    assert spectrum.n == len(x) and sums == x.sum(axis=0).tolist()
    want = scatter(x.astype(float))
    assert np.abs((spectrum.vectors * spectrum.values) @ spectrum.vectors.T - want).max() < 1e-11 * np.abs(want).max()


def test_whitening_odd_and_empty(spark):
    kind = "vec_id long, embedding array<double>, x int, n int, component string, `a.b` int"
    odd = [
        (1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [0.5, -0.0]), (3, None), (4, [float("nan"), 1.0]),
        (5, [None, 1.0]), (6, [1.0]), (7, []), (8, [-0.25, 1e3]), (9, [float("inf"), 0.0]),
    ]
    table = spark.createDataFrame([(*r, 1, 2, "c", 3) for r in odd], kind)
    got = whitening.whiten(table).collect()
    assert sorted(str(r["vec_id"]) for r in got) == ["1"] * 4 + ["8"] * 2 + ["None"] * 2
    assert all(r["n"] == 3 and r["identity_error"] < 1e-12 and r["whitened"] is not None for r in got)
    huge = spark.createDataFrame([(1, [1e300, 0.0]), (2, [-1e300, 0.0]), (3, [0.0, 0.0])], "vec_id long, embedding array<double>")
    seen = {(r["vec_id"], r["component"]): r for r in whitening.whiten(huge).collect()}
    assert seen[1, 1]["deviation"] is None and seen[1, 2]["whitened"] is None and seen[1, 2]["explained"] == 0
    one = whitening.whiten(table.where("vec_id = 1")).collect()
    assert len(one) == 4 and all(r["whitened"] is None and r["deviation"] == 0 and r["explained"] is None for r in one)
    assert whitening.whiten(table.where("vec_id = 3")).collect() == []
    assert whitening.whiten(table.where("vec_id = 3")).schema == whitening.whiten(table).schema


def test_contract_columns(spark):
    want = {
        "op11_decontamination": "doc_id n_words n_hit n_items items_sha256 contaminated",
        "op12_search": "item_id rank doc_id score",
        "op13_whitening": "vec_id component n deviation whitened explained identity_error",
    }
    kinds = {"rank": "int", "component": "int", "items_sha256": "string", "contaminated": "boolean"}
    kinds |= {"whitened": "double", "explained": "double", "identity_error": "double"}
    for name, columns in want.items():
        schema = queries.QUERIES[name](spark, SMALL).schema
        assert schema.names == columns.split()
        for field in schema:
            assert field.dataType.simpleString() == kinds.get(field.name, "bigint"), field
