"""Quality rules: per-document counts and cross-document line frequency.

One pass over the texts counts words, symbols, repeated lines and repeated three-word windows, and hashes every
normalised line together with its host. A line's frequency is the number of distinct documents (by content, so exact
copies count once) of the host that hold it. Lines above the limit are boilerplate: they are taken out, and a document
of which less than half the words are left is depleted and rejected.

Only hashes leave the first pass. Distinct (line, content) pairs are counted in two steps with partial aggregation, so a
line that a third of all documents share costs a task no more than any other; the join back to the documents is an
equi-join without an aggregate that needs its partitioning, so adaptive execution can split a hot line.

Defined cases: null and empty texts have no word and fail the base rules. Rows that repeat an id, host and text are judged
alike; rows that share an id, or have none, are judged each by its host and text. A null host is a host of its own. An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, slices, table

SYMBOLS = b"#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: A line is too frequent in a host if over MIN_DOCS of its documents and over SHARE of them hold it.
MIN_DOCS, SHARE = 20, 0.05
#: A document is depleted if less than this part of its words is left.
LEAST_LEFT = 0.5

FEATURES = "doc_id long, host long, content long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, line_keys array<long>, line_words array<int>"
_SPACE = re.compile(r"[ \t\n\x0b\x0c\r]")
_DIGITS = re.compile(r"\d+")
_NOT_WORD = re.compile(r"[^\w]+")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _host(source: str | None) -> bytes:
    return b"\1" + source.encode() if source is not None else b"\0"


def _content(text: str) -> int:
    return _signed(xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")))


def normalise_line(line: str) -> str:
    """Lower case, each run of digits as 0, every other run of signs and spaces as one space."""
    return _NOT_WORD.sub(" ", _DIGITS.sub("0", line.lower())).strip()


def repeat_words(words: list[bytes]) -> int:
    """Words inside three-word windows that occur twice or more, the first included."""
    n = len(words) - 2
    if n < 2:
        return 0
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == n:
        return 0
    seen, total, upto = Counter(windows), 0, 0
    for i, w in enumerate(windows):
        if seen[w] > 1:
            total += i + 3 - max(i, upto)
            upto = i + 3
    return total


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a whole text."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines, dup = raw.split(b"\n"), 0
    if len(lines) > 1 and len(set(lines)) < len(lines):
        seen = set()
        for line in lines:
            if line in seen and line.split():
                dup += 1
            seen.add(line)
    spaces = len(raw) - len(raw.translate(None, b" \t\n\x0b\x0c\r"))
    return len(words), len(text) - spaces, symbols, dup, repeat_words(words)


def line_counts(text: str, host: bytes) -> dict[int, int]:
    """For each distinct normalised line (hashed with its host): its words in the text, all occurrences together."""
    out: dict[int, int] = {}
    for line in text.split("\n"):
        if n := len(line.encode("utf-8", "surrogatepass").split()):
            key = _signed(xxhash.xxh3_64_intdigest(host + b"\0" + normalise_line(line).encode("utf-8", "surrogatepass")))
            out[key] = out.get(key, 0) + n
    return out


def features(docs: DataFrame) -> DataFrame:
    """The one pass over the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None
        for b in slices(batches):
            rows: list[list] = [[] for _ in range(10)]
            for doc_id, source, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                text = text or ""
                host = _host(source)
                lines, content = line_counts(text, host), _content(text)
                for to, x in zip(rows, (doc_id, _signed(xxhash.xxh3_64_intdigest(host)), content, *base_counts(text), list(lines), list(lines.values())), strict=True):
                    to.append(x)
            schema = schema or pa.schema([(n, pa.int64()) for n in ("doc_id", "host", "content", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")] + [("line_keys", pa.list_(pa.int64())), ("line_words", pa.list_(pa.int32()))])
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(rows, schema, strict=True)], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("text").cast("string")).mapInArrow(run, FEATURES)


def frequent_lines(feats: DataFrame, min_docs: int = MIN_DOCS, share: float = SHARE) -> DataFrame:
    """line: hashes (each with its host) above the limit."""
    held = feats.select("host", "content", F.explode("line_keys").alias("line"))
    counted = held.groupBy("host", "line").agg(F.countDistinct("content").alias("n_docs")).where(F.col("n_docs") > min_docs)
    hosts = feats.groupBy("host").agg(F.countDistinct("content").alias("host_docs"))
    return counted.join(hosts, "host").where(F.col("n_docs") > share * F.col("host_docs")).select("line")


_ROW = ["doc_id", "host", "content"]


def _marked(feats: DataFrame, min_docs: int, share: float) -> DataFrame:
    """Id, host and content of rows that hold lines above the limit, and those lines with their words."""
    lines = feats.select(*_ROW, F.explode(F.arrays_zip("line_keys", "line_words")).alias("x")).select(*_ROW, F.col("x.line_keys").alias("line"), F.col("x.line_words").alias("words"))
    # A set, as rows that repeat a document hold the same lines. It is gathered by document, a dealing other than the
    # join's, so that the join may split a hot line.
    return lines.join(frequent_lines(feats, min_docs, share), "line").groupBy(*_ROW).agg(F.collect_set(F.struct("line", "words")).alias("lines"))


def _judged(feats: DataFrame, min_docs: int, share: float, least_left: float) -> DataFrame:
    hit = _marked(feats, min_docs, share).select(*[F.col(c).alias(f"_{c}") for c in _ROW], F.col("lines").alias("_lines"))
    match = feats["doc_id"].eqNullSafe(hit["_doc_id"]) & (feats["host"] == hit["_host"]) & (feats["content"] == hit["_content"])
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    gone = F.coalesce(F.aggregate("_lines", F.lit(0).cast("long"), lambda n, x: n + x["words"]), F.lit(0).cast("long"))
    return feats.join(hit, match, "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        (~failed & (F.col("n_words") - gone >= least_left * F.col("n_words"))).alias("kept"), gone.alias("n_boiler_words"), "content", "host", F.col("_lines").alias("lines"),
    )


def judge(docs: DataFrame, min_docs: int = MIN_DOCS, share: float = SHARE, least_left: float = LEAST_LEFT, feats: DataFrame | None = None) -> DataFrame:
    """doc_id, the base counts, base_failed, n_boiler_words, kept, and content (a hash); one row for each row of docs.
    feats: the features of docs, if they are at hand."""
    feats = Scratch(docs.sparkSession, "rules").keep(features(docs)) if feats is None else feats
    return _judged(feats, min_docs, share, least_left).drop("host", "lines")


def _act(docs: DataFrame, acted: DataFrame) -> DataFrame:
    """The rows of docs that acted (id, host and content of a row, kept, and lines to cut) doesn't reject, their lines cut.
    Rows meet by id, host and content together, so rows without an id, or that share one, aren't one group."""
    import pandas as pd

    def host_key(sources):
        return pd.Series([_signed(xxhash.xxh3_64_intdigest(_host(s))) for s in sources], dtype="int64")

    def content_key(texts):
        return pd.Series([_content(t or "") for t in texts], dtype="int64")

    def cut(texts, sources, gone):
        def one(text, source, keys):
            if text is None or keys is None:
                return text
            host, keys = _host(source), set(keys)
            return "\n".join(x for x in text.split("\n") if not set(line_counts(x, host)) & keys)

        return pd.Series([one(*x) for x in zip(texts, sources, gone, strict=True)], dtype=object)

    for f in (host_key, content_key, cut):
        f.__annotations__ = dict.fromkeys(f.__code__.co_varnames[: f.__code__.co_argcount], pd.Series) | {"return": pd.Series}
    source, text = docs["source"].cast("string"), docs["text"].cast("string")
    keyed = docs.select("*", F.pandas_udf(host_key, "long")(source).alias("_rule_host"), F.pandas_udf(content_key, "long")(text).alias("_rule_content"))
    known = acted.dropDuplicates(_ROW).select(*[F.col(c).alias(f"_acted_{c}") for c in _ROW], F.col("kept").alias("_acted_kept"), F.col("lines").alias("_acted_lines"))
    match = docs["doc_id"].cast("long").eqNullSafe(known["_acted_doc_id"]) & (F.col("_rule_host") == known["_acted_host"]) & (F.col("_rule_content") == known["_acted_content"])
    left = keyed.join(known, match, "left").where(F.coalesce("_acted_kept", F.lit(True)))
    stripped = F.pandas_udf(cut, "string")(text, source, F.col("_acted_lines"))
    return left.select(*[stripped.alias("text") if c == "text" else docs[c] for c in docs.columns])


def apply(docs: DataFrame, min_docs: int = MIN_DOCS, share: float = SHARE, least_left: float = LEAST_LEFT) -> DataFrame:
    """The rows of docs that ``judge`` keeps, with lines above the limit taken out of their texts. Documents that are
    rejected count towards a line's frequency."""
    feats = Scratch(docs.sparkSession, "rules").keep(features(docs))
    judged = _judged(feats, min_docs, share, least_left).where(~F.col("kept") | F.col("lines").isNotNull())
    return _act(docs, judged.select(*_ROW, "kept", F.when(F.col("kept"), F.col("lines.line")).alias("lines")))


def strip_frequent(docs: DataFrame, min_docs: int = MIN_DOCS, share: float = SHARE) -> DataFrame:
    """All rows of docs, with lines above the limit taken out of their texts."""
    feats = Scratch(docs.sparkSession, "strip").keep(features(docs))
    return _act(docs, _marked(feats, min_docs, share).select(*_ROW, F.lit(True).alias("kept"), F.col("lines.line").alias("lines")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents")).drop("content")


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
#: The same rules over lines and words as strings. sf tables are small, so no line is hashed.
ORACLE_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
t AS (SELECT r, unnest(range(1, len(w) - 1)) AS i, w FROM d WHERE len(w) > 2),
g AS (SELECT r, i, count(*) OVER (PARTITION BY r, w[i], w[i + 1], w[i + 2]) AS n FROM t),
rep AS (SELECT r, count(DISTINCT j) AS n_repeat_words FROM (SELECT r, unnest([i, i + 1, i + 2]) AS j FROM g WHERE n > 1) GROUP BY r),
sp AS (SELECT r, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS k FROM d),
l AS (SELECT r, k, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words FROM sp),
dup AS (SELECT r, count(*) AS n_dup_lines FROM (SELECT r, row_number() OVER (PARTITION BY r, line ORDER BY k) AS o FROM l WHERE words > 0) WHERE o > 1 GROUP BY r),
n AS (SELECT l.r, d.source, d.text, words, trim(regexp_replace(regexp_replace(lower(line), '\p{{Nd}}+', '0', 'g'), '[^\p{{L}}\p{{N}}_]+', ' ', 'g')) AS line FROM l JOIN d USING (r) WHERE words > 0),
h AS (SELECT source, count(DISTINCT text) AS docs FROM d GROUP BY source),
f AS (SELECT n.source, line FROM n GROUP BY n.source, line HAVING count(DISTINCT text) > {MIN_DOCS}),
fl AS (SELECT f.source, f.line FROM f JOIN h ON f.source IS NOT DISTINCT FROM h.source JOIN n ON n.source IS NOT DISTINCT FROM f.source AND n.line = f.line
       GROUP BY f.source, f.line, h.docs HAVING count(DISTINCT n.text) > {SHARE} * h.docs),
b AS (SELECT n.r, sum(words) AS gone FROM n JOIN fl ON n.source IS NOT DISTINCT FROM fl.source AND n.line = fl.line GROUP BY n.r),
o AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
      (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
      coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(gone, 0)::BIGINT AS n_boiler_words
      FROM d LEFT JOIN rep USING (r) LEFT JOIN dup USING (r) LEFT JOIN b USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words) AS base_failed,
       n_boiler_words, NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words) AND n_words - n_boiler_words >= {LEAST_LEFT} * n_words AS kept FROM o
"""
