"""Text expressions: stripping, tokens, chunking and keyword scoring."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the characters that count as white space, as a regular-expression class.
SPACE = (
    r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)

# Words a question may contain that never act as keywords.
STOPWORDS = (
    "the a an is are was were what how why when where which who do does did can could "
    "will would should in on at to for of with and or not this that it i me my you your "
    "we they he she be have has had"
).split()

# Chunk length and overlap in characters, section and paragraph marks.
CHUNK_SIZE = 800
CHUNK_OVERLAP = 100
SECTION_MARK = "\n## "
PARAGRAPH_MARK = "\n\n"

# Score added per keyword present, and for the whole question present.
KEYWORD_BONUS = 2
QUESTION_BONUS = 10


def strip(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, f"^{SPACE}+", ""), f"{SPACE}+$", "")


def tokens(text: Column) -> Column:
    """White-space separated tokens; punctuation stays."""
    return F.filter(F.split(text, f"{SPACE}+"), lambda t: t != "")


def keywords(question: Column) -> Column:
    """Distinct lower-case tokens without stopwords; all tokens if nothing else is left."""
    words = F.array_distinct(tokens(F.lower(question)))
    useful = F.array_except(words, F.array(*[F.lit(w) for w in STOPWORDS]))
    return F.when(F.size(useful) > 0, useful).otherwise(words)


def occurrences(text: Column, word: Column) -> Column:
    """Non-overlapping occurrences of ``word`` in ``text``."""
    removed = F.length(text) - F.length(F.replace(text, word, F.lit("")))
    return F.try_divide(removed, F.length(word)).cast("long")


#: Paragraphs folded at once: a step of a fold copies its state, which holds no more bounds than these.
FOLDED_TOGETHER = 256


def _bounds(paragraphs: Column, size: int, overlap: int, mark: str) -> Column:
    """The chunks' (first, last, length): paragraphs that hold a chunk, and its characters up to the last one's end.

    With the mark before each paragraph every chunk is a part of the same text that ends where a paragraph ends, so the
    fold carries offsets only. The characters repeated from the chunk before lie in its last few paragraphs. An outer
    fold goes over blocks of paragraphs, an inner one over a block.
    """
    number, bounds = F.lit(0), "array<struct<first:int,last:int,length:int>>"
    back = -(-overlap // max(1, len(mark)))  # paragraphs that ``overlap`` characters can touch
    places = ("first", "last", "length")

    def closed(state: Column) -> Column:
        return F.array(F.struct(*[state[p].alias(p) for p in places]))

    def add(state: Column, paragraph: Column) -> Column:
        length = F.length(paragraph)
        full = (state["length"] + length > size) & (state["length"] > 0)
        kept = F.when(full, F.least(state["length"], F.lit(overlap))).otherwise(state["length"])
        earliest = F.greatest(state["first"], state["last"] - (back - 1))
        return F.struct(
            F.when(full, earliest).otherwise(state["first"]).alias("first"),
            (state["last"] + 1).alias("last"),
            (kept + len(mark) + length).alias("length"),
            F.when(full, F.concat(state["ended"], closed(state))).otherwise(state["ended"]).alias("ended"),
        )

    def add_block(state: Column, block: Column) -> Column:
        start = F.struct(*[state[p].alias(p) for p in places], F.array().cast(bounds).alias("ended"))
        held = F.slice(paragraphs, block * FOLDED_TOGETHER + 1, FOLDED_TOGETHER)
        return F.aggregate(
            held,
            start,
            add,
            lambda inner: F.struct(
                *[inner[p].alias(p) for p in places],
                F.concat(state["ended"], F.array(inner["ended"])).alias("ended"),
            ),
        )

    blocks = F.sequence(number, F.floor((F.size(paragraphs) - 1) / FOLDED_TOGETHER).cast("int"))
    nothing = F.struct(
        *[number.alias(p) for p in places], F.array().cast(f"array<{bounds}>").alias("ended")
    )
    return F.aggregate(
        blocks, nothing, add_block, lambda state: F.concat(F.flatten(state["ended"]), closed(state))
    )


def _pack_paragraphs(section: Column, size: int, overlap: int, paragraph_mark: str) -> Column:
    """Greedy packing of paragraphs into chunks, in time linear in the text; a long paragraph is never cut."""

    def cut(paragraphs: Column) -> Column:
        def chunk(bound: Column) -> Column:
            first = F.greatest(bound["first"], F.lit(1))
            held = F.slice(paragraphs, first, bound["last"] - first + 1)
            text = F.concat(F.lit(paragraph_mark), F.array_join(held, paragraph_mark))
            return strip(F.right(text, bound["length"]))

        return F.transform(_bounds(paragraphs, size, overlap, paragraph_mark), chunk)

    def without_empty_end(chunks: Column) -> Column:
        empty = F.element_at(chunks, -1) == ""
        return F.slice(chunks, 1, F.size(chunks) - empty.cast("int"))

    # Arrays of one, so that the paragraphs and the chunks are made once and not for each use.
    chunks = F.transform(F.array(F.split(section, paragraph_mark)), cut)
    return F.flatten(F.transform(chunks, without_empty_end))


def chunk_array(
    text: Column,
    size: int = CHUNK_SIZE,
    overlap: int = CHUNK_OVERLAP,
    paragraph_mark: str = PARAGRAPH_MARK,
) -> Column:
    """Chunks of one text, in order, as an array of strings."""

    def chunks_of(section: Column, position: Column) -> Column:
        prefix = F.when(position > 0, SECTION_MARK.lstrip("\n")).otherwise("")
        whole = F.concat(prefix, section)
        return F.when(F.length(whole) <= size, F.array(strip(whole))).otherwise(
            _pack_paragraphs(whole, size, overlap, paragraph_mark)
        )

    return F.flatten(F.transform(F.split(text, SECTION_MARK), chunks_of))
