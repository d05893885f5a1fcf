"""Line dedup by a log-template tree, in DataFrame functions alone.

Each line that isn't blank descends a tree of fixed depth: first its number of tokens, then the leading
half of its tokens, where a variable field (a token with a digit) matches as ``<*>``.  In the leaf it has
the template that is left when every variable field is ``<*>``.  A leaf then generalises its templates, in
whatever order lines come: a place behind the leading tokens is variable if at least ``min_docs`` of the
leaf's templates are equal but for their tokens there.  Lines of under ``LEAST_TOKENS`` tokens are left as
they are, since too little of them would be left to tell them by.  A template's variable places are settled
one by one, each with all other tokens equal; fields among the leading tokens vary only by digits.

A template recurs if at least ``min_docs`` texts have it; texts whose lines have the same templates
are copies and count once.  A line also counts as one that may recur if it has ``LEAF_TOKENS`` tokens or more and
its leaf does.  A text of which at most half may recur stands for itself; more means that it is a near copy of
others, which are to be judged as documents and aren't emptied for being many.  A recurring template is dropped from
all documents if at least ``min_docs`` of its texts stand for themselves, and a quarter of them.

Null text counts as empty: it has one blank line.  Blank lines stay and count nowhere.  Rows that repeat
an id, and those with a null id, are judged by their own texts, and each loses its own lines that go.  Empty
tables give empty results.  A text of any length is one row; its lines are exploded.  Other columns are kept by
:func:`drop_lines`, whatever their names; ``__id``, ``__version`` and ``__gone`` are its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwise.llm.workspace import Workspace

LEAST_TOKENS = 5
#: Lines of so many tokens have leaves that unrelated texts hardly share: four leading tokens or more.
LEAF_TOKENS = 8
MIN_DOCS = 5


def _generalised(lines: Column) -> Column:
    """Each line's tokens with one space between them, and variable fields as ``<*>``.

    Regular expressions are slow, so only lines that need them meet them.  Each step is a transform of
    its own, since an expression that a lambda uses twice is computed twice.
    """
    trimmed = F.transform(lines, lambda x: F.trim(x))  # noqa: PLW0108 - a second parameter of trim would get the index
    squeezed = F.transform(trimmed, lambda x: F.when(F.contains(x, F.lit("  ")), F.regexp_replace(x, " {2,}", " ")).otherwise(x))
    return F.transform(squeezed, lambda x: F.when(x.rlike("[0-9]"), F.regexp_replace(x, r"[^ 0-9]*+[0-9][^ ]*+", "<*>")).otherwise(x))


def _template(general: Column) -> Column:
    """Number of tokens, hash of the path and hash of the template; null for a blank line."""
    tokens = F.length(general) - F.length(F.replace(general, F.lit(" "), F.lit(""))) + 1
    leading = F.call_function("substring_index", general, F.lit(" "), F.shiftright(tokens, 1))
    return F.when(general != "", F.struct(tokens.alias("tokens"), F.xxhash64(tokens, leading).alias("leaf"), F.xxhash64(general).alias("template")))


def _spaced(text: Column) -> Column:
    """Other white space than line ends as spaces."""
    other = F.contains(text, F.lit("\t")) | F.contains(text, F.lit("\r")) | F.contains(text, F.lit("\x0b")) | F.contains(text, F.lit("\f"))
    return F.when(other, F.translate(text, "\t\r\x0b\f", "    ")).otherwise(text)


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text.cast("string"), F.lit("")), "\n", -1)


def line_templates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, version, sequence, n_lines, pos, tokens, leaf, template): a row per line that isn't blank.

    ``sequence`` is the hash of all the text's templates, ``n_lines`` their number."""
    found = F.transform(F.transform(_generalised(_lines(_spaced(F.col(text_col).cast("string")))), _template), lambda x, i: F.struct(i.alias("pos"), x.alias("t")))
    own = F.filter(found, lambda x: x["t"].isNotNull())
    # In an array of one, since a column that is used twice would be computed twice.
    once = F.transform(F.array(own), lambda o: F.struct(F.xxhash64(F.transform(o, lambda x: x["t"]["template"])).alias("sequence"), F.size(o).alias("n_lines"), o.alias("own")))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("version"), F.inline(once))
    rows = rows.select("doc_id", "version", "sequence", "n_lines", F.inline("own"))
    return rows.select("doc_id", "version", "sequence", "n_lines", "pos", "t.tokens", "t.leaf", "t.template")


def _tokens_of(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(leaf, template, words) of the ``wanted`` lines (__id, __version, own: array of (pos, leaf, template)) of ``docs``."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.xxhash64(F.col(text_col)).alias("version"))
    joined = rows.join(wanted, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("version") == F.col("__version"))).withColumn("lines", _lines(_spaced(F.col("text"))))
    picked = joined.select(F.inline(F.transform("own", lambda x: F.struct(x["leaf"].alias("leaf"), x["template"].alias("template"), F.get("lines", x["pos"]).alias("line")))))
    return picked.select("leaf", "template", F.split(_generalised(F.array("line"))[0], " ").alias("words")).dropDuplicates(["leaf", "template"])


def generalised_templates(ws: Workspace, docs: DataFrame, lines: DataFrame, min_docs: int = MIN_DOCS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(leaf, template, general): what a leaf's templates with variable places become."""
    # Any line of a template will do, and primitive columns keep the aggregate in hash tables.
    each = lines.filter(F.col("tokens") >= LEAST_TOKENS).groupBy("leaf", "template").agg(*[F.first(c).alias(c) for c in ("doc_id", "version", "pos")])
    each = ws.save(each, "each")
    # Most leaves of prose have too few templates for any place to be variable.
    full = ws.save(each.groupBy("leaf").agg(F.count("*").alias("n")).filter(F.col("n") >= min_docs).select("leaf"), "full")
    wanted = each.join(full.hint("merge"), "leaf").groupBy(F.col("doc_id").alias("__id"), F.col("version").alias("__version")).agg(F.collect_list(F.struct("pos", "leaf", "template")).alias("own"))
    # Written, so that Spark knows its size and need not shuffle the texts if it is small.
    words = ws.save(_tokens_of(docs, ws.save(wanted, "wanted"), id_col, text_col), "words")
    # The exclusive or of all places but one stands for the line without that place's token.
    hashed = words.select("leaf", "template", F.transform("words", lambda w, i: F.xxhash64(w, i)).alias("h"))
    hashed = hashed.withColumn("all", F.aggregate("h", F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(x)))
    places = hashed.select("leaf", "template", "all", F.size("h").alias("size"), F.posexplode("h").alias("place", "own")).filter(F.col("place") >= F.shiftright(F.col("size"), 1))
    places = places.withColumn("rest", F.col("all").bitwiseXOR(F.col("own")))
    variable = ws.save(places.groupBy("leaf", "place", "rest").agg(F.count("*").alias("n")).filter(F.col("n") >= min_docs).drop("n"), "variable")
    found = places.join(variable.hint("merge"), ["leaf", "place", "rest"]).groupBy("leaf", "template", "all").agg(F.array_sort(F.collect_set("place")).alias("at"), F.expr("bit_xor(own)").alias("gone"))
    return ws.save(found.select("leaf", "template", F.xxhash64("leaf", "at", F.col("all").bitwiseXOR(F.col("gone"))).alias("general")), "general")


def _often(pairs: DataFrame, by: str, min_docs: int) -> DataFrame:
    return pairs.select(by, "sequence").distinct().groupBy(by).agg(F.count("*").alias("n")).filter(F.col("n") >= min_docs).select(by)


def places_to_drop(spark: SparkSession, docs: DataFrame, min_docs: int = MIN_DOCS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, version, gone): positions of the lines that go, for the documents that lose any."""
    ws = Workspace(spark, "lines")
    lines = ws.save(line_templates(docs, id_col, text_col), "lines")
    general = generalised_templates(ws, docs, lines, min_docs, id_col, text_col)
    # Small tables are written first, so that joins read both sides from shuffles and a hot template's lines can be split.
    pairs = ws.save(lines.select("leaf", "template", "tokens", "sequence").distinct().join(general.hint("merge"), ["leaf", "template"], "left").withColumn("general", F.coalesce("general", "template")), "pairs")
    often = ws.save(_often(pairs, "general", min_docs), "often")
    recurring = ws.save(pairs.select("leaf", "template", "general").distinct().join(often.hint("merge"), "general"), "recurring")
    place = ["sequence", "doc_id", "version", "n_lines", "pos"]
    hits = ws.save(lines.join(recurring.hint("merge"), ["leaf", "template"]).select(*place, F.col("general").alias("template")), "hits")
    leaves = ws.save(_often(pairs.filter(F.col("tokens") >= LEAF_TOKENS), "leaf", min_docs), "leaves")
    near = hits.select(*place).unionByName(lines.filter(F.col("tokens") >= LEAF_TOKENS).join(leaves.hint("merge"), "leaf").select(*place))
    most = near.groupBy("sequence", "doc_id", "version", "n_lines").agg(F.countDistinct("pos").alias("n")).filter(F.col("n") * 2 > F.col("n_lines"))
    most = ws.save(most.select("sequence").distinct().withColumn("near", F.lit(1)), "near")
    votes = hits.select("template", "sequence").distinct().join(most.hint("merge"), "sequence", "left").groupBy("template").agg(F.count("*").alias("n"), F.count("near").alias("near"))
    alone = F.col("n") - F.col("near")
    templates = ws.save(votes.filter((alone >= min_docs) & (alone * 4 >= F.col("n"))).select("template"), "templates")
    gone = hits.join(templates.hint("merge"), "template").select("doc_id", "version", "pos")
    places = ws.save(gone.groupBy("doc_id", "version").agg(F.collect_set("pos").alias("gone")), "gone")
    ws.close("gone")
    return places


def drop_lines(spark: SparkSession, docs: DataFrame, min_docs: int = MIN_DOCS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the recurring lines taken out of ``text_col``, and the lines' counts in
    ``__n_lines`` and ``__n_dropped``."""
    places = places_to_drop(spark, docs, min_docs, id_col, text_col).select(F.col("doc_id").alias("__id"), F.col("version").alias("__version"), F.col("gone").alias("__gone"))
    joined = docs.join(places.hint("merge"), F.col(id_col).eqNullSafe(F.col("__id")) & (F.xxhash64(F.col(text_col)) == F.col("__version")), "left")
    lines = _lines(F.col(text_col))
    kept = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains(F.col("__gone"), i)), "\n")
    n_gone = F.coalesce(F.size("__gone"), F.lit(0))
    return joined.select(
        *[F.when(F.col("__gone").isNull(), F.col(c)).otherwise(kept).alias(c) if c == text_col else F.col(c) for c in docs.columns],
        F.size(lines).cast("long").alias("__n_lines"),
        F.when(F.col("__gone").isNull(), 0).otherwise(n_gone).cast("long").alias("__n_dropped"),
    )


def line_dedup(spark: SparkSession, docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_chars, kept_sha256 of every row of ``docs`` (doc_id, text)."""
    out = drop_lines(spark, docs.select("doc_id", "text"), min_docs)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return out.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_dropped").alias("n_dropped"), F.length(text).cast("long").alias("kept_chars"), F.sha2(text.cast("binary"), 256).alias("kept_sha256"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
with l as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos from documents),
t as (
  select *, nullif(regexp_replace(trim(regexp_replace(line, '[ \t\r\x0B\f]+', ' ', 'g')), '[^ ]*[0-9][^ ]*', '<*>', 'g'), '') as template from l),
q as (select doc_id, string_agg(template, chr(10) order by pos) as sequence, count(template) as n_lines from t group by doc_id),
e as (select *, len(w) || ' ' || array_to_string(w[1:len(w) // 2], ' ') as leaf from (select template, string_split(template, ' ') as w from (select distinct template from t where template is not null)) where len(w) >= 5),
i as (select leaf, template, w, unnest(range(len(w) // 2 + 1, len(w) + 1)) as i from e where leaf in (select leaf from e group by leaf having count(*) >= 5)),
r as (select leaf, template, i, count(*) over (partition by leaf, i, array_to_string(w[:i - 1], ' '), array_to_string(w[i + 1:], ' ')) as n from i),
a as (select template, list(i order by i) as places from r where n >= 5 group by template),
g as (
  select template, cast(places as varchar) || ' ' || array_to_string(list_transform(string_split(template, ' '), lambda x, k: case when list_contains(places, k) then '' else x end), ' ') as general from a),
d as (
  select t.doc_id, t.pos, t.line, coalesce(general, t.template) as template, sequence, n_lines, len(string_split(t.template, ' ')) as tokens,
    len(string_split(t.template, ' ')) || ' ' || array_to_string(string_split(t.template, ' ')[1:len(string_split(t.template, ' ')) // 2], ' ') as leaf
  from t join q using (doc_id) left join g using (template)),
c as (select template from d where template is not null group by template having count(distinct sequence) >= 5),
v as (select leaf from d where tokens >= 8 group by leaf having count(distinct sequence) >= 5),
h as (select doc_id, count(*) filter (c.template is not null or v.leaf is not null) * 2 <= any_value(n_lines) as alone from d left join c using (template) left join v on v.leaf = d.leaf and tokens >= 8 group by doc_id),
f as (
  select template from d join c using (template) join h using (doc_id) group by template
  having count(distinct case when alone then sequence end) >= 5 and count(distinct case when alone then sequence end) * 4 >= count(distinct sequence)),
k as (select d.doc_id, d.pos, d.line, f.template is not null as gone from d left join f using (template)),
o as (select doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped, coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '') as kept from k group by doc_id)
select doc_id, n_lines, n_dropped, length(kept) as kept_chars, sha256(kept) as kept_sha256 from o
"""
