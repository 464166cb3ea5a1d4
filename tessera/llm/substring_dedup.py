"""Substring dedup by hashing of text units.

Texts are cut into units: lines, and within lines sentences (after final marks
and before capitalised words, so that a passage pasted into the middle of a
line is cut as it is elsewhere). Units are normalised (case, white space, marks
at their ends) and hashed; digests are grouped over all texts, and the earliest
occurrence, by id and then place, is the one to keep. A later occurrence is
repeated. Lines and paragraphs of several units are hashed as a whole too: a
repeated one is removed if it has at least ``line_words`` words, or ``min_words``
where a line is the whole text. Inside lines, units that chance repeats, such as a
one-word sentence, are no passages: a run of repeated units is removed if it has
at least ``min_words`` words. In scripts without spaces between words two
characters (four in Thai, Lao, Burmese and Khmer) count as a word, and units end
at full-width marks, or at spaces. Offsets of what is removed refer to the
original text.
"""

from __future__ import annotations

import re
import struct

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from tessera.llm.common import Written, map_rows, map_texts, read

#: Words that a run of repeated units must have, a unit at its ends, and a repeated line or paragraph.
MIN_WORDS, END_WORDS, LINE_WORDS = 25, 3, 4
_TWO = struct.Struct(">qq")
_CUT = re.compile(r"\s*\n\s*|(?<=[.!?…])\s+|\s+(?=[A-ZÀ-ÖØ-ÞΑ-ΩА-Я])")
_ENDS = " \t.,;:!?…\"'()[]。｡，、；：！？「」『』（）"
#: Characters of scripts without spaces: those that stand for half a word, and for a quarter.
_HALF, _QUARTER = r"\u3005-\u3007\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff", r"\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff"
_HALVES, _QUARTERS, _UNSPACED = re.compile(f"[{_HALF}]"), re.compile(f"[{_QUARTER}]"), re.compile(f"[{_HALF}{_QUARTER}]")
_CUT_UNSPACED = re.compile(_CUT.pattern + rf"|(?<=[。｡！？])(?![。｡！？」』”’）])\s*|(?<=[。｡！？][」』”’）])\s*|(?<=[{_QUARTER}])\s+(?=[{_QUARTER}])")


def units(text: str) -> list[tuple[int, int]]:
    """Spans of the units of a text, in order; what lies between is white space."""
    out, at = [], 0
    for m in (_CUT_UNSPACED if _UNSPACED.search(text) else _CUT).finditer(text):
        if m.start() > at:
            out.append((at, m.start()))
        at = m.end()
    if at < len(text) and text[at:].strip():
        out.append((at, len(text)))
    return [(s, e) for s, e in out if not text[s:e].isspace()]


def normal(unit: str) -> str:
    return " ".join(unit.lower().split()).strip(_ENDS)


def digest(unit: str) -> tuple[int, int]:
    """128 bits as two signed integers: of 10^12 different units two are alike with probability below 10^-14."""
    return _TWO.unpack(xxhash.xxh3_128_digest(normal(unit)))


def size(text: str) -> int:
    """Words of a text; characters count where words have no spaces between them."""
    if text.isascii() or not _UNSPACED.search(text):
        return len(text.split())
    spaced = sum(any(c.isalnum() for c in w) for w in _UNSPACED.sub(" ", text).split())
    return spaced + -(-(2 * len(_HALVES.findall(text)) + len(_QUARTERS.findall(text))) // 4)


def blocks(text: str, spans: list[tuple[int, int]]) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Lines, and paragraphs of several lines, as ranges of units."""
    gaps = [text.count("\n", spans[k - 1][1], spans[k][0]) for k in range(1, len(spans))]
    lines, paragraphs = ([0, *(k for k, n in enumerate(gaps, 1) if n >= least), len(spans)] for least in (1, 2))
    lines, paragraphs = (list(zip(at, at[1:])) if spans else [] for at in (lines, paragraphs))
    known = set(lines)
    return lines, [x for x in paragraphs if x not in known]


def passages(text: str) -> list[tuple[int, tuple[int, int]]]:
    """(mark, digest) of units k (mark 3 k), and of lines (1 more) and paragraphs (2 more) of several units from k on."""
    spans = units(text)
    out = [(3 * k, digest(text[s:e])) for k, (s, e) in enumerate(spans)]
    for kind, ranges in enumerate(blocks(text, spans), 1):
        out += [(3 * a + kind, digest(text[spans[a][0] : spans[b - 1][1]])) for a, b in ranges if len(_core(text, spans, a, b)) > 1]
    return out


def _core(text: str, spans: list[tuple[int, int]], a: int, b: int) -> list[int]:
    """Of the units a to b, those with more than marks."""
    return [a] if b - a == 1 else [k for k in range(a, b) if normal(text[slice(*spans[k])])]


def repeated_runs(text: str, spans: list[tuple[int, int]], repeated: list[int], min_words: int = MIN_WORDS, line_words: int = LINE_WORDS) -> list[tuple[int, int]]:
    """Spans to remove, given the marks of what is repeated."""
    marks, gone = set(repeated), set()
    flags = {x // 3 for x in marks if x % 3 == 0}
    lines, paragraphs = blocks(text, spans)
    least = line_words if len(lines) > 1 else min_words
    for kind, ranges in enumerate((lines, paragraphs), 1):
        for a, b in ranges:
            core = _core(text, spans, a, b)
            if 3 * a + kind in marks or (len(core) == 1 and core[0] in flags):
                flags.update(range(a, b))
                if size(text[spans[a][0] : spans[b - 1][1]]) >= least:
                    gone.update(range(a, b))
    k, n = 0, len(spans)
    while k < n:
        if k not in flags:
            k += 1
            continue
        first = k
        while k < n and k in flags:
            k += 1
        sizes = [size(text[s:e]) for s, e in spans[first:k]]
        if sum(sizes) < min_words:
            continue
        a, b = 0, len(sizes)
        while a < b and sizes[a] < END_WORDS:
            a += 1
        while b > a and sizes[b - 1] < END_WORDS:
            b -= 1
        a, b = (0, len(sizes)) if a == b else (a, b)
        gone.update(range(first + a, first + b))
    out = []
    for k in sorted(gone):
        if k - 1 in gone:
            out[-1] = (out[-1][0], spans[k][1])
        else:
            out.append(spans[k])
    return out


def without(text: str, runs: list[tuple[int, int]]) -> str:
    """The text without some spans and the white space behind each."""
    out, at = [], 0
    for s, e in runs:
        out.append(text[at:s])
        at = e
        while at < len(text) and text[at].isspace():
            at += 1
    out.append(text[at:])
    return "".join(out).rstrip() if runs else text


def _key(text: Column) -> Column:
    return F.xxhash64(text)


def repeated_units(docs: DataFrame, store: Written, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, key, repeated array<int>) of texts with passages that occur earlier, by mark; key: hash of the text."""

    def make():
        def run(rows):
            out = {"id": [], "key": [], "at": [], "a": [], "b": []}
            for i, key, t in zip(rows["id"], rows["key"], rows["text"]):
                found = passages(t or "")
                out["id"] += [i] * len(found)
                out["key"] += [key] * len(found)
                out["at"] += [at for at, _ in found]
                out["a"] += [x[0] for _, x in found]
                out["b"] += [x[1] for _, x in found]
            return out

        return run

    rows = docs.select(F.col(id_col).cast("long").alias("id"), _key(F.col(text_col)).alias("key"), F.col(text_col).alias("text")).where("text <> ''")
    found = store.write(map_rows(rows, make, "id long, key long, at int, a long, b long", "text"))
    # Id and place as one number, so that minima are combined in hash tables before
    # the shuffle, and one join that can be split where a digest is hot does the rest.
    place = F.coalesce("id", F.lit(2**63 - 1)).cast("decimal(19,0)") * F.lit(2**31).cast("decimal(10,0)") + F.col("at").cast("decimal(10,0)")
    first = found.groupBy("a", "b").agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1").drop("n")
    # Written, so that the join has plain exchanges on both sides: only then can a hot digest be split.
    first = store.write(first)
    later = found.join(first, ["a", "b"]).where(place > F.col("first"))
    return later.groupBy("id", "key").agg(F.collect_set("at").alias("repeated"))


def dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size_col: str | None = None, min_words: int = MIN_WORDS, spans_col: str | None = None) -> DataFrame:
    """Rows of docs with repeated passages removed from their texts; all columns are kept.

    size_col, if docs has it, is set to the new number of characters; spans_col,
    if given, is added: original offsets of what was removed, "start:end" joined
    by commas. It takes the place of a column of that name. Null and empty texts
    stay as they are. Rows that repeat an id rank alike: each keeps what the id
    holds first. Null ids come last. A row stays even when all of its text goes.
    """
    if spans_col is not None:
        docs = docs.drop(*(c for c in docs.columns if c.lower() == spans_col.lower()))
    store = Written(docs.sparkSession)
    found = repeated_units(docs, store, id_col=id_col, text_col=text_col)
    found = found.select(F.col("id").alias("__tsr_id"), F.col("key").alias("__tsr_key"), F.col("repeated").alias("__tsr_repeated"))
    whole = docs.join(found, docs[id_col].cast("long").eqNullSafe(F.col("__tsr_id")) & (_key(docs[text_col]) == F.col("__tsr_key")), "left").drop("__tsr_id", "__tsr_key")
    names = docs.columns

    def run(batch):
        i, j = batch.schema.get_field_index(text_col), batch.schema.get_field_index("__tsr_repeated")
        texts, gone = [], []
        for t, r in zip(batch.column(i), batch.column(j)):
            r, t = r.as_py(), t.as_py()
            runs = repeated_runs(t, units(t), r, min_words) if r and t else []
            texts.append(without(t, runs) if runs else t)
            gone.append(",".join(f"{s}:{e}" for s, e in runs))
        columns = [pa.array(texts, batch.schema.field(k).type) if k == i else c for k, c in enumerate(batch.columns) if k != j]
        return pa.RecordBatch.from_arrays([*columns, pa.array(gone, pa.string())], names=[*names, "__tsr_spans"])

    out = map_texts(whole, run, StructType([*docs.schema.fields]).add("__tsr_spans", StringType()), text_col)
    if size_col in docs.columns:
        out = out.withColumn(size_col, F.length(text_col).cast(docs.schema[size_col].dataType))
    return out.drop("__tsr_spans") if spans_col is None else out.withColumnRenamed("__tsr_spans", spans_col)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup(read(spark, sf_dir, "documents").select("doc_id", "text"), spans_col="removed")
    return out.select("doc_id", "text", "removed", F.when(F.col("removed") == "", 0).otherwise(F.size(F.split("removed", ","))).alias("n_removed"))
