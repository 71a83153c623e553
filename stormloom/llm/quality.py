"""Quality rules: counts within a text, and the frequency of its lines across the documents of its host.

Normalised lines are hashed and the distinct documents that have each are counted per host; lines above the limit are
taken out, and a document of which too few words remain is rejected.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD, shared_table
from .line_dedup import BROADCAST_LINES, frequent_lines, with_frequent

#: A line may be in this share of its host's documents, or in so many if that is more, so that small hosts have a limit.
MAX_DOCS, MAX_SHARE = 5, 0.01
#: Percentage of a document's words that must remain. Where a document has frequent lines, they hold 4 % of its words in
#: the median, and a quarter in one such document of a hundred.
MIN_LEFT = 75
MIN_WORDS, MAX_REPEATED = 50, 50
SYMBOLS = "#*$%&|<>"


def normalise_line(line: Column) -> Column:
    """Lower case, white space runs to one space, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(line), r"[\x20\x09-\x0D]+", " "))


def text_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    n = len(words)
    chars = len(text or "") - len(data.translate(None, delete=bytes(b for b in range(256) if b not in b" \t\n\v\f\r")))
    symbols = len(data) - len(data.translate(None, delete=SYMBOLS.encode()))
    lines = [x for x in data.split(b"\n") if x and not x.isspace()]
    repeated = 0
    if n >= 4:
        windows = list(zip(words, words[1:], words[2:], strict=False))
        counts = Counter(windows)
        if len(counts) < len(windows):
            end = 0  # words before it are counted
            for i, w in enumerate(windows):
                if counts[w] > 1:
                    repeated += i + 3 - max(i, end)
                    end = i + 3
    return n, chars, symbols, len(lines) - len(set(lines)), repeated


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_docs: int = MAX_DOCS, max_share: float = MAX_SHARE, min_left: int = MIN_LEFT, broadcast_lines: int = BROADCAST_LINES) -> DataFrame:
    """One row per row of docs: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_frequent_words (long),
    base_failed, kept (boolean).

    base_failed: fewer than MIN_WORDS words, or more than MAX_REPEATED per cent of them in repeated 3-word windows.
    n_frequent_words are those in lines above the limit. A null text counts as empty, and fails. Null hosts are one
    host. Rows of equal ids are documents of their own. Other columns aren't read. No rows in: no rows out.
    """
    docs = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{host_col}`").alias("source"))

    def limit(pages: Column) -> Column:
        return F.greatest(F.lit(float(max_docs)), max_share * pages)

    bad = shared_table(frequent_lines(docs, "source", "text", limit, normalise_line, max_docs), "frequent-lines")
    marked = with_frequent(docs, bad, "source", "text", normalise_line, broadcast_lines)
    gone = F.transform(F.filter("__lines", lambda x: x["frequent"]), lambda x: x["line"])
    frequent = F.coalesce(F.regexp_count(F.array_join(gone, "\n"), F.lit(WORD)), F.lit(0)).cast("long")
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    schema = T.StructType([T.StructField("id", docs.schema["id"].dataType), *[T.StructField(n, T.LongType()) for n in (*names, "n_frequent_words")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [text_counts(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[k] for r in rows], pa.int64()) for k in range(5)), batch.column(2)], names=[f.name for f in schema.fields])

    counted = marked.select("id", "text", frequent.alias("n_frequent_words")).mapInArrow(run, schema)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    left = 100 * (F.col("n_words") - F.col("n_frequent_words")) >= min_left * F.col("n_words")
    return counted.select(F.col("id").alias(id_col), *names, "n_frequent_words", failed.alias("base_failed"), (~failed & left).alias("kept"))
