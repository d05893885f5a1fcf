"""Language identification: multinomial naive Bayes over hashed character n-grams.

Text is lower-cased, every character that is no letter becomes a space, and the 1- to 3-grams of
code points are hashed to 2**16 features.  Two documented bounds hold for learning, and every other step covers
all rows: the ``languages`` commonest values of ``lang`` are learned (of equally common ones those that sort
first), and counts come from about ``rows_per_language`` distinct labelled texts of each at most, chosen by a hash
of the text.  Priors count all labelled rows of a learned value.  The log-probability matrix (features x languages,
doubles, 512 KB a language, 100 MB at most) is broadcast; whole texts are scored in numpy, in blocks of bounded size.

Texts that are null, or have no letter, are ``und`` with score 0, as is every text if nothing could
be learned.  Ties go to the language that sorts first.  Null ids are never held out.  Rows that repeat count in
the priors, and their text once in the counts.  Other columns, whatever their names, are ignored, or kept by
:func:`accepted`.  Empty tables give empty results.  A text of any length is scored by one task, which holds about
40 bytes for each of its characters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwise.llm.workers import lean

FEATURES = 1 << 16
ORDERS = (1, 2, 3)
ROWS_PER_LANGUAGE = 5000
LANGUAGES = 200
BLOCK_CHARS = 1 << 20
SMOOTHING = 0.5
UNKNOWN = "und"

_LETTER: np.ndarray | None = None


def _letters() -> np.ndarray:
    global _LETTER
    if _LETTER is None:
        _LETTER = np.array([chr(i).isalpha() for i in range(0x110000)])
    return _LETTER


def codes(text: str) -> np.ndarray:
    """Lower-cased code points; 32 stands for whatever is no letter."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    return np.where(_letters()[c], c, np.uint32(32))


def features(c: np.ndarray, order: int) -> np.ndarray:
    """Feature of the n-gram that begins at each code point but the last order - 1."""
    n = len(c) - order + 1
    h = np.full(max(n, 0), order * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
    for k in range(order if n > 0 else 0):
        h = (h ^ c[k : k + n]) * np.uint32(0x85EBCA6B)
        h ^= h >> np.uint32(13)
    return h >> np.uint32(16)


def blocks(texts: list[str | None]) -> Iterator[tuple[list[int], list[np.ndarray]]]:
    """Indices and code points of the texts that have letters, a bounded number of characters at a time."""
    held, size, at = [], 0, []
    for i, t in enumerate(texts):
        c = codes(t) if t else np.zeros(0, np.uint32)
        if not (c != 32).any():
            continue
        at.append(i)
        held.append(c)
        size += len(c)
        if size >= BLOCK_CHARS:
            yield at, held
            held, size, at = [], 0, []
    if at:
        yield at, held


def score(texts: list[str | None], table: np.ndarray, prior: np.ndarray) -> np.ndarray:
    """Log joint probability of each text and language; rows of NaN for texts without a letter."""
    out = np.full((len(texts), len(prior)), np.nan)
    for at, held in blocks(texts):
        # Two spaces end each text, so no n-gram that counts spans two texts.
        gap = np.full(2, 32, np.uint32)
        c = np.concatenate([x for h in held for x in (h, gap)])
        starts = np.concatenate([[0], np.cumsum([len(h) + 2 for h in held])])[:-1]
        total = np.zeros((len(held), len(prior)))
        for order in ORDERS:
            f = features(c, order)
            counted = c[: len(f)] != 32
            for lang in range(len(prior)):
                total[:, lang] += np.add.reduceat(np.where(counted, table[lang][f], 0.0), np.minimum(starts, len(f) - 1), dtype=np.float64)
        out[at] = total + prior
    return out


def count(texts: list[str | None]) -> np.ndarray:
    out = np.zeros(FEATURES, np.int64)
    gap = np.full(2, 32, np.uint32)
    for _, held in blocks(texts):
        c = np.concatenate([x for h in held for x in (h, gap)])
        for order in ORDERS:
            f = features(c, order)
            out += np.bincount(f[c[: len(f)] != 32], minlength=FEATURES)
    return out


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}
    rows: dict[str, int] = {}
    for b in batches:
        texts = np.array(b.column("text").to_pylist(), dtype=object)
        langs = np.array(b.column("lang").to_pylist(), dtype=object)
        for lang in set(langs):
            own = texts[langs == lang]
            sums[lang] = sums.get(lang, 0) + count(list(own))
            rows[lang] = rows.get(lang, 0) + len(own)
    if sums:
        yield pa.record_batch([pa.array(list(sums)), pa.array([x.astype("<u4").tobytes() for x in sums.values()], pa.binary()), pa.array(list(rows.values()), pa.int64())], names=["lang", "counts", "rows"])


def picked(labelled: DataFrame, rows_per_language: int = ROWS_PER_LANGUAGE, languages: int = LANGUAGES) -> tuple[DataFrame, dict[str, int]]:
    """The distinct (text, lang) to learn from, and the labelled rows of each language that is learned."""
    known = labelled.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    most = known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(languages)
    totals = {r["lang"]: r["n"] for r in most.collect()}
    if not totals:
        return known.select("text", "lang"), totals
    share = F.create_map(*[x for k, n in totals.items() for x in (F.lit(k), F.lit(min(1.0, rows_per_language / n)))])
    # Null where the language isn't learned.
    lot = F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < F.try_element_at(share, F.col("lang")) * float(1 << 30)
    return known.filter(lot).select("text", "lang").distinct(), totals


def fit(labelled: DataFrame, rows_per_language: int = ROWS_PER_LANGUAGE, languages: int = LANGUAGES) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(languages, log-probabilities (language, feature), log priors) from (text, lang)."""
    rows, totals = picked(labelled, rows_per_language, languages)
    if not totals:
        return [], np.zeros((0, FEATURES)), np.zeros(0)
    parts = rows.repartition(12).mapInArrow(lean(_count_batches), "lang string, counts binary, rows long").collect()
    langs = sorted({p["lang"] for p in parts})
    if not langs:
        return [], np.zeros((0, FEATURES)), np.zeros(0)
    counts = np.zeros((len(langs), FEATURES))
    for p in parts:
        counts[langs.index(p["lang"])] += np.frombuffer(p["counts"], "<u4")
    smooth = counts + SMOOTHING
    table = np.log(smooth / smooth.sum(axis=1, keepdims=True))
    weight = np.array([totals[x] for x in langs], float)
    return langs, table, np.log(weight / weight.sum())


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray], keep: list[str], into: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``keep`` columns of ``docs`` (text) with the predicted language and its posterior probability, in columns
    named by ``into``."""
    langs, table, prior = model
    text = "text" if "text" in keep else "__text"
    shared = docs.sparkSession.sparkContext.broadcast((langs, table, prior))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, logp, base = shared.value
        for b in batches:
            n = b.num_rows
            pred, best = np.full(n, UNKNOWN, dtype=object), np.zeros(n)
            if names and n:
                joint = score(b.column(text).to_pylist(), logp, base)
                seen = ~np.isnan(joint[:, 0])
                j = joint[seen]
                top = j.argmax(axis=1) if len(j) else np.zeros(0, int)
                pred[seen] = np.array(names, dtype=object)[top]
                best[seen] = 1.0 / np.exp(j - j.max(axis=1, keepdims=True)).sum(axis=1) if len(j) else []
            yield pa.record_batch([*[b.column(c) for c in keep], pa.array(pred.tolist(), pa.string()), pa.array(best)], names=[*keep, *into])

    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    rows = docs.select(*keep) if text == "text" else docs.select(*keep, F.col("text").alias("__text"))
    return rows.mapInArrow(lean(run), f"{fields}, `{into[0]}` string, `{into[1]}` double")


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def language_id(docs: DataFrame, rows_per_language: int = ROWS_PER_LANGUAGE) -> DataFrame:
    """doc_id, held_out, lang_pred, score for ``docs`` (doc_id, text, lang); learns from rows not held out."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    model = fit(rows.filter(~held_out()).select("text", "lang"), rows_per_language)
    return predict(rows.select("doc_id", held_out().alias("held_out"), "text"), model, ["doc_id", "held_out"])


def accepted(docs: DataFrame, least_score: float = 0.5, rows_per_language: int = ROWS_PER_LANGUAGE) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, lang, ...) whose language is known with at least ``least_score``."""
    model = fit(docs.filter(~held_out()).select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")), rows_per_language)
    rows = predict(docs, model, docs.columns, ("__lang", "__score"))
    return rows.filter((F.col("__lang") != UNKNOWN) & (F.col("__score") >= least_score)).select(*docs.columns)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = language_id(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang"))
    return rows.withColumn("score", F.round("score", 6))


def _mixed(h: str, c: str) -> str:
    """SQL of the hash ``h`` after the code point ``c``, as in :func:`features`."""
    m = f"((xor(cast({h} as ubigint), {c}) * {0x85EBCA6B}) & {0xFFFFFFFF})"
    return f"xor({m}, {m} >> 13)"


def _start(order: int) -> str:
    return str(order * 0x9E3779B1 & 0xFFFFFFFF)


# The same counts and sums, for tables of which all distinct texts are learned from: up to ROWS_PER_LANGUAGE rows a language.
SQL = r"""
with recursive d as (
  select doc_id, text, lang, list_reduce(
      list_prepend(cast(4294967295 as ubigint), flatten(list_transform(string_split(cast(doc_id as varchar), ''), lambda ch: list_prepend(cast(unicode(ch) as ubigint), list_transform(range(8), lambda z: cast(4294967296 as ubigint)))))),
      lambda a, o: case when o < 4294967296 then xor(a, o) else xor(a >> 1, cast(3988292384 as ubigint) * (a & 1)) end) as crc
  from documents),
e as (select doc_id, text, lang, xor(crc, cast(4294967295 as ubigint)) % 4 = 2 as held_out from d),
c as (
  select doc_id, list_concat(list_transform(string_split(lower(text), ''), lambda ch: cast(case when regexp_matches(ch, '\p{L}') then unicode(ch) else 32 end as ubigint)), [cast(32 as ubigint), cast(32 as ubigint)]) as c
  from e where text is not null and text <> ''),
w as (select doc_id, c[i] as c0, c[i + 1] as c1, c[i + 2] as c2 from (select doc_id, c, unnest(range(1, len(c) - 1)) as i from c) where c[i] <> 32),
s1 as (select doc_id, c0, c1, c2, {one} as a, {two} as b, {three} as t from w),
s2 as (select doc_id, c2, a, {b} as b, {t} as t from s1),
g as (select doc_id, a >> 16 as f from s2 union all select doc_id, b >> 16 from s2 union all select doc_id, {last} >> 16 from s2),
n as (select doc_id, f, count(*) as n from g group by all),
l as (select min(doc_id) as doc_id, lang from e where not held_out and lang is not null and text is not null group by text, lang),
p as (select lang, ln(count(*) / sum(count(*)) over ()) as prior from e where not held_out and lang is not null and text is not null group by lang),
k as (select lang, f, sum(n) as k from l join n using (doc_id) group by all),
z as (select lang, sum(k) + 32768 as z from k group by lang),
x as (
  select doc_id, lang, prior + sum(n * ln((coalesce(k, 0) + 0.5) / z)) as x
  from n, p join z using (lang) left join k on k.lang = p.lang and k.f = n.f group by doc_id, lang, prior),
y as (select doc_id, arg_max(lang, (x, -r)) as lang_pred, max(x) as x from (select *, row_number() over (partition by doc_id order by lang) as r from x) group by doc_id),
v as (select doc_id, 1 / sum(exp(x.x - y.x)) as score from x join y using (doc_id) group by doc_id)
select doc_id, coalesce(held_out, false) as held_out, coalesce(lang_pred, 'und') as lang_pred, round(coalesce(score, 0), 6) as score from e left join y using (doc_id) left join v using (doc_id)
"""
for _name, _part in {"one": _mixed(_start(1), "c0"), "two": _mixed(_start(2), "c0"), "three": _mixed(_start(3), "c0"), "b": _mixed("b", "c1"), "t": _mixed("t", "c1"), "last": _mixed("t", "c2")}.items():
    SQL = SQL.replace("{" + _name + "}", _part)
