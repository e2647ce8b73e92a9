"""Document chunks, keyword retrieval and chat prompts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterlight.functions import text as T
from meterlight.functions.calendar import iso_label
from meterlight.functions.keywords import counter
from meterlight.functions.quantiles import exact_median
from meterlight.schema import DAY, HOUSEHOLD, SEASON_NAMES, TARGET
from meterlight.session import PARTITIONS_SETTING, materialize, ship

TOP_K = 4
FALLBACK_CHUNKS = 3
HISTORY = 6
SUMMARY_SOURCE = "Live Data Summary"
DEFAULT_SYSTEM_PROMPT = (
    "You answer questions about metered energy consumption. "
    "Use only the given context, and say so when it does not hold the answer."
)
CHUNK_KEY = ["doc_id", "chunk_ord"]
# Chunks whose pairs with questions a task holds, and keywords that travel to the tasks at once.
CHUNKS_OF_TASK = 8192
KEYWORDS_AT_ONCE = 200_000


# Chunks


def chunk_text(
    documents: DataFrame,
    size: int = T.CHUNK_SIZE,
    overlap: int = T.CHUNK_OVERLAP,
    paragraph_mark: str = T.PARAGRAPH_MARK,
) -> DataFrame:
    """(doc_id, source, chunk_ord, content): every document cut into overlapping chunks."""
    chunks = T.chunk_array(F.col("text"), size, overlap, paragraph_mark)
    return documents.select(
        "doc_id", "source", F.posexplode(chunks).alias("chunk_ord", "content")
    )


def live_summary(
    df: DataFrame, leaderboard: DataFrame | None = None, best: str | None = None
) -> DataFrame:
    """(line_no, line): the figures of the loaded table as text."""
    y = F.col(TARGET)
    median = exact_median(df, TARGET)

    def two(value: Column) -> Column:
        return F.format_string("%.2f", value)

    def mean_where(condition: Column) -> Column:
        return two(F.avg(F.when(condition, y)))

    lines = [
        F.lit("## Live Dataset Summary"),
        F.concat(F.lit("- Total records: "), F.format_number(F.count("*"), 0)),
        F.concat(F.lit("- Unique households: "), F.countDistinct(HOUSEHOLD).cast("string")),
        F.concat(
            F.lit("- Date range: "), iso_label(F.min(DAY)), F.lit(" to "), iso_label(F.max(DAY))
        ),
        F.concat(F.lit("- Average daily energy (kWh): "), two(F.avg(y))),
        F.concat(F.lit("- Median daily energy (kWh): "), two(F.lit(median))),
        F.concat(F.lit("- Max daily energy (kWh): "), two(F.max(y))),
        F.concat(F.lit("- Min daily energy (kWh): "), two(F.min(y))),
        F.concat(F.lit("- Std deviation of daily energy (kWh): "), two(F.stddev_samp(y))),
    ]
    if "season" in df.columns:
        lines += [F.lit(""), F.lit("## Seasonal Average Energy Consumption")]
        for number, name in enumerate(SEASON_NAMES):
            here = F.col("season") == number
            line = F.concat(F.lit(f"- {name}: "), mean_where(here), F.lit(" kWh"))
            lines.append(F.when(F.count_if(here) > 0, line))
    if "is_weekend" in df.columns:
        lines += [F.lit(""), F.lit("## Weekend vs Weekday")]
        for name, flag in (("Weekend", 1), ("Weekday", 0)):
            mean = mean_where(F.col("is_weekend") == flag)
            lines.append(F.concat(F.lit(f"- {name} average: "), mean, F.lit(" kWh")))
    body = df.agg(*[line.alias(f"l{i}") for i, line in enumerate(lines)]).select(
        F.posexplode(F.array_compact(F.array(*[f"l{i}" for i in range(len(lines))]))).alias(
            "line_no", "line"
        )
    )
    if leaderboard is not None:
        head = _numbered(df, 1000, ["", "## Model Performance (Baseline)"])
        rank = F.row_number().over(Window.orderBy("Model"))
        models = leaderboard.select(
            (rank + 1001).alias("line_no"),
            F.format_string("- %s: MAE=%.4f, RMSE=%.4f, R²=%.4f", "Model", "MAE", "RMSE", "R2").alias(
                "line"
            ),
        )
        body = body.unionByName(head).unionByName(models)
    if best is not None:
        body = body.unionByName(_numbered(df, 2000, ["", f"## Best Model: {best}"]))
    return body.orderBy("line_no")


def _numbered(df: DataFrame, start: int, lines: list[str]) -> DataFrame:
    rows = [(start + i, line) for i, line in enumerate(lines)]
    return df.sparkSession.createDataFrame(rows, "line_no int, line string")


def summary_chunk(summary: DataFrame) -> DataFrame:
    """The summary lines as one chunk; they are a few dozen at most."""
    lines = F.transform(
        F.sort_array(F.collect_list(F.struct("line_no", "line"))), lambda r: r["line"]
    )
    return summary.agg(F.array_join(lines, "\n").alias("content")).select(
        F.lit(None).cast("long").alias("doc_id"),
        F.lit(SUMMARY_SOURCE).alias("source"),
        F.lit(0).alias("chunk_ord"),
        "content",
    )


def knowledge_base(chunks: DataFrame, summary: DataFrame | None = None) -> DataFrame:
    """Document chunks, then the summary chunk (its document id sorts last)."""
    if summary is None:
        return chunks
    last = F.lit((1 << 63) - 1)
    return chunks.unionByName(summary_chunk(summary).withColumn("doc_id", last))


# Scores for one question


def keyword_score(chunks: DataFrame, question: str) -> DataFrame:
    """Score of every chunk for one question: a projection, no shuffle.

    Occurrences of each keyword, a bonus per keyword present and a bonus when the whole
    question occurs.
    """
    lowered = question.lower()
    words = set(lowered.split())
    words = sorted(words - set(T.STOPWORDS) or words)
    body = F.col("body")

    def of_word(word: str) -> Column:
        count = T.occurrences(body, F.lit(word))
        return count + F.when(F.contains(body, F.lit(word)), T.KEYWORD_BONUS).otherwise(0)

    whole = F.when(F.contains(body, F.lit(lowered)), T.QUESTION_BONUS).otherwise(0)
    score = reduce(lambda a, b: a + b, [of_word(w) for w in words], whole.cast("long"))
    prepared = chunks.withColumn("body", F.lower("content"))
    return prepared.withColumn("score", score).drop("body")


def retrieve_top_k(chunks: DataFrame, question: str, k: int = TOP_K) -> DataFrame:
    """Best chunks for one question by score then position; the first ones if none score.

    One top-n selection, which keeps n rows per task. Where nothing scores, that order is
    the order of the chunks, so the same few rows answer both cases.
    """
    order = [F.desc("score"), *CHUNK_KEY]
    top = keyword_score(chunks, question).orderBy(*order).limit(max(k, FALLBACK_CHUNKS))
    placed = top.withColumns(
        {
            "place": F.row_number().over(Window.orderBy(*order)),
            "best": F.max("score").over(Window.orderBy(*order)),
        }
    )
    scoring = (F.col("score") > 0) & (F.col("place") <= k)
    fallback = (F.col("best") == 0) & (F.col("place") <= FALLBACK_CHUNKS)
    return placed.filter(scoring | fallback).drop("place", "best")


# Scores for a table of questions


def question_keywords(questions: DataFrame) -> DataFrame:
    """(question_id, keyword, n_keywords) for questions that are not blank."""
    words = T.keywords(F.col("question"))
    return questions.select(
        "question_id", F.explode(words).alias("keyword"), F.size(words).alias("n_keywords")
    )


def keyword_hits(chunks: DataFrame, words: DataFrame, parts: int) -> DataFrame:
    """(doc_id, chunk_ord, keyword, hits): how often the keywords of ``words`` occur in each chunk's ``body``.

    The distinct keywords go to every task, at most KEYWORDS_AT_ONCE of them in a pass over the chunks, whose
    vocabulary meets no table. A chunk's keywords leave as one row a pass, for one of ``parts`` partitions by its key.
    """
    spark = chunks.sparkSession
    ship(spark)
    distinct = materialize(words.select("keyword").distinct(), "keywords")
    passes = max(1, -(-distinct.count() // KEYWORDS_AT_ONCE))
    hits = []
    for i in range(passes):
        own = distinct.where(F.pmod(F.xxhash64("keyword"), F.lit(passes)) == i).collect()
        found = counter(spark.sparkContext.broadcast(tuple(sorted(r["keyword"] for r in own))))(F.col("body"))
        hits.append(chunks.select(*CHUNK_KEY, found.alias("found")))
    placed = reduce(DataFrame.unionByName, hits).repartition(parts, *CHUNK_KEY)
    return placed.select(*CHUNK_KEY, F.inline(F.arrays_zip("found.keyword", "found.hits")))


def keyword_scores(chunks: DataFrame, questions: DataFrame) -> DataFrame:
    """(question_id, doc_id, chunk_ord, score) for every pair with a positive score.

    The keywords come to the chunks. Everything about a chunk stays in the partition its key hashes to: its words,
    its text, and the questions that reach it where their keywords are broadcast. So pairs stream into the ranking,
    which keeps a few for each question and task, and are neither shuffled nor stored. The number of partitions
    follows the chunks, so that a task's pairs do not outgrow its memory.
    """
    words = materialize(question_keywords(questions), "question-keywords")
    spark = chunks.sparkSession
    parts = max(int(spark.conf.get(PARTITIONS_SETTING)), -(-chunks.count() // CHUNKS_OF_TASK))
    placed = chunks.select(*CHUNK_KEY, F.lower("content").alias("body")).repartition(parts, *CHUNK_KEY)
    per_word = keyword_hits(placed, words, parts).groupBy(*CHUNK_KEY, "keyword").agg(F.sum("hits").alias("hits"))
    pairs = (
        per_word.join(words, "keyword")
        .groupBy("question_id", *CHUNK_KEY)
        .agg(
            F.sum(F.col("hits") + T.KEYWORD_BONUS).alias("base"),
            (F.count("*") == F.max("n_keywords")).alias("all_present"),
        )
    )
    asked = questions.select("question_id", F.lower("question").alias("asked"))
    whole = F.col("all_present") & F.contains("body", "asked")
    score = F.col("base") + F.when(whole, T.QUESTION_BONUS).otherwise(0)
    scored = pairs.join(placed, CHUNK_KEY).join(asked, "question_id")
    key = ["question_id", *CHUNK_KEY]
    return scored.select(*key, score.cast("long").alias("score")).unionByName(
        blank_scores(placed, asked)
    )


def blank_scores(bodies: DataFrame, asked: DataFrame) -> DataFrame:
    """Chunks that hold a question without any word; it has no keyword, only the bonus.

    Such questions differ in their white space alone, so each kind is looked up once.
    """
    blank = asked.filter(F.trim(F.translate("asked", "\t\n\r", "   ")) == "")
    kinds = blank.agg(F.collect_set("asked")).scalar()
    held = bodies.withColumn("kinds", kinds).select(
        *CHUNK_KEY,
        F.explode(F.filter("kinds", lambda kind: F.contains(F.col("body"), kind))).alias("asked"),
    )
    return held.join(blank, "asked").select(
        "question_id", *CHUNK_KEY, F.lit(T.QUESTION_BONUS).cast("long").alias("score")
    )


def retrieve(chunks: DataFrame, questions: DataFrame, k: int = TOP_K) -> DataFrame:
    """(question_id, rank, doc_id, chunk_ord, source, content, score) per question.

    A question without any scored chunk gets the first chunks with score zero. The top-k
    is limited per map task before the shuffle, so a keyword found in most chunks does not
    gather them in one task. The chosen keys are stored before the texts are fetched.
    """
    order = Window.partitionBy("question_id").orderBy(F.desc("score"), *CHUNK_KEY)
    ranked = keyword_scores(chunks, questions).withColumn("rank", F.row_number().over(order))
    best = materialize(ranked.filter(F.col("rank") <= k), "retrieved-keys")
    first = chunks.select(*CHUNK_KEY).orderBy(*CHUNK_KEY).limit(FALLBACK_CHUNKS)
    position = F.row_number().over(Window.orderBy(*CHUNK_KEY))
    slots = first.select(*CHUNK_KEY, position.alias("rank"), F.lit(0).cast("long").alias("score"))
    without = questions.select("question_id").join(
        best.select("question_id").distinct(), "question_id", "left_anti"
    )
    fallback = without.withColumn(
        "rank", F.explode(F.sequence(F.lit(1), F.lit(FALLBACK_CHUNKS)))
    ).join(F.broadcast(slots), "rank")

    def with_text(keys: DataFrame) -> DataFrame:
        return chunks.join(keys, CHUNK_KEY).select(
            "question_id", "rank", *CHUNK_KEY, "source", "content", "score"
        )

    return with_text(best).unionByName(with_text(fallback))


def build_context(retrieved: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One context text per question from its few chunks, best first."""
    entry = F.concat(F.lit("[Source: "), "source", F.lit("]\n"), "content")
    ordered = F.sort_array(F.collect_list(F.struct("rank", entry.alias("entry"))))
    return retrieved.groupBy(*(keys or ["question_id"])).agg(
        F.array_join(F.transform(ordered, lambda r: r["entry"]), "\n\n---\n\n").alias("context")
    )


# Chat prompts


def chat_window(messages: DataFrame, n: int = HISTORY) -> DataFrame:
    """Last messages of each conversation; limited per task before the shuffle."""
    latest = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return (
        messages.withColumn("age", F.row_number().over(latest))
        .filter(F.col("age") <= n)
        .select("conv_id", "turn", "role", F.col("text").alias("content"))
    )


def user_message(context: Column, question: Column) -> Column:
    return F.concat(
        F.lit("Context from knowledge base:\n\n"),
        context,
        F.lit("\n\n---\n\nUser question: "),
        question,
    )


def chat_messages(
    history: DataFrame,
    questions: DataFrame,
    contexts: DataFrame,
    system_prompt: str = DEFAULT_SYSTEM_PROMPT,
    n: int = HISTORY,
) -> DataFrame:
    """(question_id, position, role, content): system prompt, recent history, question.

    ``questions`` names the conversation of each question in ``conv_id``; the history before
    it is the conversation's last messages.
    """
    start = questions.select(
        "question_id",
        F.lit(-1).cast("long").alias("turn"),
        F.lit("system").alias("role"),
        F.lit(system_prompt).alias("content"),
    )
    recent = questions.select("question_id", "conv_id").join(
        chat_window(history, n), "conv_id"
    )
    last = questions.join(contexts, "question_id").select(
        "question_id",
        F.lit((1 << 63) - 1).alias("turn"),
        F.lit("user").alias("role"),
        user_message(F.col("context"), F.col("question")).alias("content"),
    )
    together = start.unionByName(recent.drop("conv_id")).unionByName(last)
    order = Window.partitionBy("question_id").orderBy("turn")
    return together.select(
        "question_id", (F.row_number().over(order) - 1).alias("position"), "role", "content"
    )
