"""Line dedup with a tree of line templates, in DataFrame functions only.

As in a log-template tree of fixed depth, a line goes down by its number of tokens and then by its first DEPTH
tokens, tokens with a digit counting as the variable <*>. In the leaf it reaches, any other token is constant at its
place if enough documents have lines with it there, else it is generalised to <*> too. What is left is the line's
template. It is one if at most 1 - SIMILARITY of its places are generalised and at least WORDS of them hold constant
words. A template that lines of enough documents have is recurring: its first line stays (smallest document id, then
position), all others are dropped.

Enough are min_docs documents, or PASSAGE_DOCS for lines of PASSAGE tokens and more: a short line may stand in two
documents by chance or because they are copies, which document-level dedup handles; a long passage may not.
A document counts once, however many of its lines have the word or the template. Lines without constant words, such as
rows of numbers, are content and stay.

Only leaves that two documents reach can hold such a template, so the first pass counts leaves by their hashes,
and the lines of other leaves go no further. Documents with the same lines in a leaf are counted together before
anything is joined, so what a third of all documents have is one row of the tree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import free_name, text_of, written

DEPTH = 4
SIMILARITY, WORDS = 0.8, 0.5
#: Documents that must share a template.
MIN_DOCS = 3
#: Lines of so many tokens need so many documents at most.
PASSAGE, PASSAGE_DOCS = 50, 2
#: Shorter lines have no template.
MIN_TOKENS = 3
VARIABLE = "<*>"
#: A token with a digit, from its first character on.
_NUMBERED = r"(?<![^ ])[^ 0-9]*+[0-9][^ ]*+"


def spaced(df: DataFrame, text: str) -> DataFrame:
    """df with white space inside the lines of its texts as single spaces; a line may keep one at its ends.

    White space is U+0020 and U+0009 to U+000D. Column by column, so that no step is worked out twice.
    """
    other = F.contains(text, F.lit("\t")) | F.contains(text, F.lit("\r")) | F.contains(text, F.lit("\x0b")) | F.contains(text, F.lit("\x0c"))
    df = df.withColumn(text, F.when(other, F.translate(text, "\t\x0b\x0c\r", "    ")).otherwise(F.col(text)))
    return df.withColumn(text, F.when(F.contains(text, F.lit("  ")), F.regexp_replace(text, " {2,}+", " ")).otherwise(F.col(text)))


def masked(line: str) -> Column:
    """The line with its tokens that have a digit as the variable."""
    return F.when(F.rlike(line, F.lit("[0-9]")), F.regexp_replace(line, _NUMBERED, VARIABLE)).otherwise(F.col(line))


def _lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """(doc, version, pos, line, n, leaf) of each line that is long enough; version tells texts of one id apart."""
    docs = df.select(F.col(key).alias("doc"), text_of(text).alias("text"))
    docs = spaced(docs.withColumn("version", F.xxhash64("text")), "text").select("doc", "version", F.split("text", "\n").alias("lines"))
    # split gives a line at least; the outer form spares a filter that would split all texts once more to see that
    lines = docs.select("doc", "version", F.posexplode_outer("lines").alias("pos", "line")).withColumn("line", F.trim("line"))
    lines = lines.where(F.octet_length(F.substring_index("line", " ", MIN_TOKENS - 1)) < F.octet_length("line"))
    lines = lines.withColumn("n", F.octet_length("line") - F.octet_length(F.replace("line", F.lit(" "), F.lit(""))) + 1).withColumn("lead", F.substring_index("line", " ", DEPTH))
    return lines.withColumn("leaf", F.xxhash64("n", masked("lead"))).drop("lead")


def _least(min_docs: int) -> Column:
    return F.when(F.col("n") >= PASSAGE, F.lit(min(min_docs, PASSAGE_DOCS))).otherwise(F.lit(min_docs))


def _judged(found: DataFrame, least: Column) -> DataFrame:
    """(leaf, id, template) of the lines with a recurring template in leaves that different lines reach."""
    # How many documents have which set of lines in a leaf; a set is at most what one document has.
    sets = found.groupBy("leaf", "n", "doc", "version").agg(F.sort_array(F.collect_set("line")).alias("lines"))
    sets = written(sets.groupBy("leaf", "n", "lines").agg(F.count("*").alias("docs")))
    # A spot is a word at its place.
    spots = F.transform("lines", lambda line: F.transform(F.split(line, " "), lambda w, at: F.when(w != VARIABLE, F.xxhash64(at, w))))
    seen = sets.select("leaf", "n", "docs", F.explode(F.array_distinct(F.array_compact(F.flatten(spots)))).alias("spot"))
    constant = seen.groupBy("leaf", "n", "spot").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= least).select("leaf", "spot", F.lit(True).alias("constant"))
    distinct = sets.select("leaf", "n", F.explode("lines").alias("line")).distinct().withColumn("id", F.xxhash64("line"))
    words = distinct.select("leaf", "n", "id", F.posexplode(F.split("line", " ")).alias("at", "word"))
    words = words.select("leaf", "n", "id", (F.col("word") == VARIABLE).alias("variable"), F.xxhash64("at", "word").alias("spot"), F.xxhash64("at", F.lit(VARIABLE)).alias("blank"))
    shapes = words.join(constant, ["leaf", "spot"], "left").groupBy("leaf", "n", "id").agg(
        F.count("constant").alias("words"), F.count_if("variable").alias("masked"), F.bit_xor(F.when(F.col("constant"), F.col("spot")).otherwise(F.col("blank"))).alias("template")
    )
    shapes = shapes.where(((F.col("words") + F.col("masked")) / F.col("n") >= SIMILARITY) & (F.col("words") / F.col("n") >= WORDS))
    shapes = written(shapes.select("leaf", "id", "template"))
    met = sets.select("leaf", "n", "docs", F.xxhash64("lines").alias("set"), F.explode("lines").alias("line")).withColumn("id", F.xxhash64("line"))
    met = met.join(shapes, ["leaf", "id"]).groupBy("leaf", "n", "template", "set").agg(F.max("docs").alias("docs"))
    recurring = met.groupBy("leaf", "n", "template").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= least)
    return shapes.join(recurring.select("leaf", "template"), ["leaf", "template"]).select("leaf", "id", "template")


def dropped_lines(df: DataFrame, key: str = "doc_id", text: str = "text", min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc, version, pos) of each line to drop."""
    lines, least = _lines(df, key, text), _least(min_docs)
    who = lines.select("leaf", "n", F.xxhash64("doc", "version").alias("who"), F.xxhash64("line").alias("line"))
    reached = who.groupBy("leaf", "n").agg(F.count("*").alias("lines"), *[f(c).alias(f"{f.__name__}_{c}") for f in (F.min, F.max) for c in ("who", "line")])
    reached = reached.where((F.col("lines") >= least) & (F.col("min_who") != F.col("max_who")))
    leaves = written(reached.select("leaf", (F.col("min_line") == F.col("max_line")).alias("alone")))
    # one plan at every size, here and below: leaves and lines grow with the corpus
    found = lines.join(leaves.hint("merge"), "leaf").withColumn("line", masked("line"))
    variables = F.when(F.contains("line", F.lit(VARIABLE)), F.regexp_count("line", F.lit(r"(?<![^ ])<\*>(?![^ ])"))).otherwise(0)
    found = found.withColumn("id", F.xxhash64("line")).withColumn("words", F.col("n") - variables).where(~F.col("alone") | (F.col("words") / F.col("n") >= WORDS))
    found = written(found.withColumn("line", F.when(~F.col("alone"), F.col("line"))))

    # A line that is alone in its leaf is its own template.
    lone = found.where("alone").groupBy("leaf", "n", "id", "doc", "version").agg(F.min("pos")).groupBy("leaf", "n", "id").agg(F.count("*").alias("docs"))
    lone = lone.where(F.col("docs") >= least).select("leaf", "id", F.lit(0).cast("long").alias("template"))
    recurring = written(lone.unionByName(_judged(found.where("NOT alone"), least)))
    places = found.groupBy("leaf", "id").agg(F.min(F.struct(F.col("doc").isNotNull().alias("known"), "doc", "pos")).alias("first"))
    first = recurring.join(places, ["leaf", "id"]).groupBy("leaf", "template").agg(F.min("first").alias("first"))
    drop = recurring.join(first, ["leaf", "template"]).select("leaf", "id", F.col("first.doc").alias("first_doc"), F.col("first.pos").alias("first_pos"))
    lost = found.select("leaf", "id", "doc", "version", "pos").join(written(drop).hint("merge"), ["leaf", "id"])
    return lost.where(~(F.col("doc").eqNullSafe(F.col("first_doc")) & (F.col("pos") == F.col("first_pos")))).select("doc", "version", "pos")


def drop_recurring_lines(df: DataFrame, key: str = "doc_id", text: str = "text", dropped: str | None = None, min_docs: int = MIN_DOCS) -> DataFrame:
    """df with its texts rid of recurring lines; other columns and all rows stay.

    dropped: a column for the number of lines dropped, if wanted. Lines end at \\n. Rows of one key and text are
    one document, with the same result; of a key with several texts each is a document of its own. A null key is
    a key like any other, before all others. A null text stays null, an empty one empty; a text that loses all
    its lines becomes empty. Lines of one template inside a single document all stay. Tables without rows stay empty.
    """
    doc, version, gone = free_name(df, "_doc"), free_name(df, "_version"), free_name(df, "_gone")
    lost = dropped_lines(df, key, text, min_docs).groupBy("doc", "version").agg(F.sort_array(F.collect_set("pos")).alias(gone))
    lost = lost.select(F.col("doc").alias(doc), F.col("version").alias(version), gone)
    joined = df.join(lost.hint("merge"), F.col(key).eqNullSafe(F.col(doc)) & (F.xxhash64(text_of(text)) == F.col(version)), "left")
    lines, n = F.split(F.col(text), "\n"), F.size(gone)
    # The runs between dropped lines, so that the work grows with the lines and not with lines times drops.
    before = lambda i: F.when(i == 0, F.lit(-1)).otherwise(F.get(gone, i - 1))
    until = lambda i: F.when(i == n, F.size(lines)).otherwise(F.get(gone, i))
    kept = F.flatten(F.transform(F.sequence(F.lit(0), n), lambda i: F.slice(lines, before(i) + 2, until(i) - before(i) - 1)))
    values = {text: F.when(F.col(gone).isNull(), F.col(text)).otherwise(F.array_join(kept, "\n"))}
    out = [values.get(c, F.col(c)).alias(c) for c in df.columns]
    if dropped:
        out.append(F.coalesce(F.size(gone), F.lit(0)).alias(dropped))
    return joined.select(*out)


#: The same for DuckDB: one row for each document, with the lines it lost and the text that is left.
SQL = rf"""
WITH whole AS (
  SELECT doc, body, row_number() OVER () AS d FROM (SELECT DISTINCT doc_id AS doc, coalesce(text, '') AS body FROM documents)
), cuts AS (
  SELECT d, doc, unnest(string_split(body, chr(10))) AS line, generate_subscripts(string_split(body, chr(10)), 1) - 1 AS pos FROM whole
), lines AS (
  SELECT d, doc, pos, list_transform(list_filter(string_split(translate(line, chr(9) || chr(11) || chr(12) || chr(13), '    '), ' '), lambda x: x <> ''), lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '{VARIABLE}' ELSE x END) AS words FROM cuts
), long AS (
  SELECT d, doc, pos, words, len(words) AS n, words[1:{DEPTH}] AS lead, CASE WHEN len(words) >= {PASSAGE} THEN {min(MIN_DOCS, PASSAGE_DOCS)} ELSE {MIN_DOCS} END AS least
  FROM lines WHERE len(words) >= {MIN_TOKENS}
), spread AS (
  SELECT DISTINCT words, n, lead, least, d FROM long
), placed AS (
  SELECT d, n, lead, least, unnest(words) AS word, generate_subscripts(words, 1) AS place FROM spread
), constant AS (
  SELECT n, lead, place, word FROM placed WHERE word <> '{VARIABLE}' GROUP BY n, lead, least, place, word HAVING count(DISTINCT d) >= least
), parted AS (
  SELECT words, n, lead, unnest(words) AS word, generate_subscripts(words, 1) AS place FROM (SELECT DISTINCT words, n, lead FROM long)
), shapes AS (
  SELECT p.words, list_aggregate(list(coalesce(c.word, '{VARIABLE}') ORDER BY p.place), 'string_agg', ' ') AS template
  FROM parted p LEFT JOIN constant c ON p.n = c.n AND p.lead = c.lead AND p.place = c.place AND p.word = c.word
  GROUP BY p.words, p.n HAVING (count(c.word) + count_if(p.word = '{VARIABLE}')) / p.n >= {SIMILARITY} AND count(c.word) / p.n >= {WORDS}
), told AS (
  SELECT l.d, l.doc, l.pos, l.least, s.template FROM long l JOIN shapes s ON l.words = s.words
), drops AS (
  SELECT template, min(struct_pack(known := doc IS NOT NULL, doc := doc, pos := pos)) AS first FROM told GROUP BY template, least HAVING count(DISTINCT d) >= least
), lost AS (
  SELECT t.d, t.pos FROM told t JOIN drops USING (template) WHERE NOT (t.doc IS NOT DISTINCT FROM drops.first.doc AND t.pos = drops.first.pos)
), kept AS (
  SELECT c.d, count(l.pos) AS n_dropped, string_agg(c.line, chr(10) ORDER BY c.pos) FILTER (l.pos IS NULL) AS text
  FROM cuts c LEFT JOIN lost l ON c.d = l.d AND c.pos = l.pos GROUP BY c.d
)
SELECT x.doc_id, CAST(k.n_dropped AS INTEGER) AS n_dropped, CASE WHEN x.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text
FROM documents x JOIN whole w ON x.doc_id IS NOT DISTINCT FROM w.doc AND coalesce(x.text, '') = w.body JOIN kept k ON w.d = k.d
"""
