"""Line dedup across all documents by a deletion-neighbourhood join.

Lines are compared as sequences of words. A line goes if an earlier line (by
doc_id, then line number) has the same words or is one word away: one word
replaced, inserted or deleted. The earliest of each kind stays. Exact copies go
whatever the length of a line that is not blank, or from ``copies_from`` words on.
Lines with fewer than ``min_words`` words have no near copies; one word, the edit
bound, is too large a part of them.

1. Equal lines collapse by a 128-bit hash to their first place.
2. Two lines one word apart share their first or last half. Lines whose halves
   nobody shares cannot have a partner and go no further; this loses nothing.
3. Every other line emits all variants with one word deleted, as hashed keys.
   Equal keys with equal deletion place mean a replaced word; a key that equals a
   whole line means an inserted one. A key's lines meet only its earliest, so a
   key with very many lines gives as many pairs as it has lines.
4. The pairs' words are compared: common first and last words must cover all but
   one. Then the earlier stays and the later goes.

Defined cases: a NULL text stays NULL; empty texts and blank lines stay; NULL ids
count as the smallest id; rows that share an id are told apart by their text, and of
rows that share both one counts as the first and the others lose all lines that are
compared; ids that are no numbers are ordered as text; an empty table gives no rows.
Only doc_id and text are read; other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, IntegralType

from haulcost.llm.words import take, words
from haulcost.sources.scratch import cut_lineage, release

MIN_WORDS = 5
#: Where a line is: its document, the document's text, its number.
PLACE = ["doc", "version", "line"]
_NULL_ID = -(1 << 63)


def _ordered(id_: Column, kind: DataType) -> Column:
    """An id that is never NULL and orders as the documents do."""
    if isinstance(kind, IntegralType):
        return F.coalesce(id_.cast("long"), F.lit(_NULL_ID))
    return F.coalesce(F.concat(F.lit("."), id_.cast("string")), F.lit(""))


def _documents(documents: DataFrame) -> DataFrame:
    docs = take(documents, doc="doc_id", text="text")
    return docs.select(
        _ordered(F.col("doc"), docs.schema["doc"].dataType).alias("doc"),
        F.xxhash64("text").alias("version"),
        "text",
    )


def _long_enough(line: Column, min_words: int) -> Column:
    space, word = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"
    return line.rlike(f"^{space}*(?:{word}+{space}+){{{min_words - 1}}}{word}")


def lines(documents: DataFrame, copies_from: int = 1) -> DataFrame:
    """The lines that are compared: place and words."""
    split = _documents(documents).select(
        "doc", "version", F.posexplode(F.split("text", "\n")).alias("line", "content")
    )
    return split.filter(_long_enough(F.col("content"), copies_from)).select(
        *PLACE, words(F.col("content")).alias("words")
    )


def _half_keys(found: str = "words") -> Column:
    """Hashes of the halves a line has in common with a partner one word away.

    For partners of at least ``s`` words, one of the first ``s div 2`` and the last
    ``s - s div 2`` words is untouched. A line meets partners with s = n and n - 1.
    """
    n = f"size({found})"
    keys = []
    for s in (n, f"({n} - 1)"):
        keys.append(f"xxhash64(1, {s}, slice({found}, 1, {s} div 2))")
        keys.append(f"xxhash64(2, {s}, slice({found}, {n} - {s} + {s} div 2 + 1, {n}))")
    return F.expr(f"array({', '.join(keys)})")


def first_lines(compared: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The first place of each different line, with the keys of its halves if it has near copies."""
    place = F.struct(*PLACE)
    halves = F.when(F.size("words") >= min_words, _half_keys())
    classes = compared.groupBy(
        F.xxhash64("words").alias("_one"), F.xxhash64(F.lit("second"), "words").alias("_two")
    ).agg(F.min(place).alias("place"), F.first(halves).alias("halves"))
    return classes.select("place.*", "halves")


def with_possible_partner(classes: DataFrame) -> DataFrame:
    """Places of lines that share a half with another line."""
    keyed = classes.select(*PLACE, F.explode("halves").alias("half"))
    shared = keyed.groupBy("half").agg(F.count("*").alias("_n")).filter("_n > 1")
    # The second key has both sides shuffled, so that Spark can split a hot half.
    shared = shared.select("half", F.hash("half").alias("_also"))
    return (
        keyed.withColumn("_also", F.hash("half"))
        .join(shared.hint("merge"), ["half", "_also"], "left_semi")
        .select(*PLACE)
        .distinct()
    )


def candidate_words(documents: DataFrame, places: DataFrame) -> DataFrame:
    """Words of the lines at the given places."""
    wanted = places.groupBy("doc", "version").agg(F.collect_set("line").alias("wanted"))
    pieces = F.split("text", "\n")
    return (
        _documents(documents)
        .join(wanted, ["doc", "version"])
        .dropDuplicates(["doc", "version"])
        .withColumn("pieces", pieces)
        .select("doc", "version", "pieces", F.explode("wanted").alias("line"))
        .select(*PLACE, words(F.expr("pieces[line]")).alias("words"))
    )


def deletion_variants(candidates: DataFrame) -> DataFrame:
    """Each line's variants with one word deleted, as (place, n, at, variant, whole).

    A sequence's hash is the xor of its words' hashes with their positions, so
    that running xors give all variants of a line in one pass over it.
    """
    each = candidates.select(
        *PLACE, F.size("words").alias("n"), F.posexplode("words").alias("at", "word")
    ).select(
        *PLACE,
        "n",
        "at",
        F.xxhash64("word", "at").alias("here"),
        F.xxhash64("word", F.col("at") - 1).alias("moved"),
    )
    line = Window.partitionBy(*PLACE)
    so_far = line.orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    before = F.expr("bit_xor(here)").over(so_far).bitwiseXOR(F.col("here"))
    after = F.expr("bit_xor(moved)").over(line).bitwiseXOR(F.expr("bit_xor(moved)").over(so_far))
    return each.select(
        *PLACE,
        "n",
        "at",
        before.bitwiseXOR(after).alias("variant"),
        F.expr("bit_xor(here)").over(line).alias("whole"),
    )


def _renamed(prefix: str) -> list[Column]:
    return [F.col(name).alias(f"{prefix}_{name}") for name in PLACE]


def near_pairs(variants: DataFrame) -> DataFrame:
    """(later, earlier) places of lines that share a key."""
    place = F.struct(*PLACE)
    keyed = variants.withColumn("_also", F.hash("variant", "at"))
    groups = (
        variants.groupBy("variant", "at", "n")
        .agg(F.min(place).alias("first"), F.count("*").alias("_n"))
        .filter("_n > 1")
        .withColumn("_also", F.hash("variant", "at"))
    )
    replaced = (
        keyed.join(groups.hint("merge"), ["variant", "at", "n", "_also"])
        .filter(place != F.col("first"))
        .select(place.alias("later"), F.col("first").alias("earlier"))
    )
    whole = variants.filter("at = 0").select(
        F.col("whole").alias("variant"), (F.col("n") + 1).alias("n"), place.alias("short")
    )
    inserted = variants.join(whole, ["variant", "n"]).select(
        F.greatest(place, F.col("short")).alias("later"), F.least(place, F.col("short")).alias("earlier")
    )
    return replaced.unionByName(inserted).distinct()


def _common(a: Column, b: Column) -> Column:
    """How many first words two lines have in common."""
    equal = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    differs = F.array_position(equal, F.lit(False))
    return F.when(differs == 0, F.size(a)).otherwise(differs - 1)


def one_word_apart(a: Column, b: Column) -> Column:
    """Whether the word-level edit distance is at most 1."""
    longest = F.greatest(F.size(a), F.size(b))
    ends = _common(a, b) + _common(F.reverse(a), F.reverse(b))
    return (F.abs(F.size(a) - F.size(b)) <= 1) & (ends >= longest - 1)


def later_lines(candidates: DataFrame, pairs: DataFrame) -> DataFrame:
    """Places of lines that an earlier one is truly near to."""
    later = candidates.select(F.struct(*PLACE).alias("later"), F.col("words").alias("later_words"))
    earlier = candidates.select(
        F.struct(*PLACE).alias("earlier"), F.col("words").alias("earlier_words")
    )
    return (
        pairs.join(later, "later")
        .join(earlier, "earlier")
        .filter(one_word_apart(F.col("later_words"), F.col("earlier_words")))
        .select("later.*")
        .distinct()
    )


def kept_places(
    documents: DataFrame, min_words: int = MIN_WORDS, copies_from: int = 1
) -> DataFrame:
    """Per document, a string of 0 and 1: which of its compared lines stay."""
    classes = cut_lineage(first_lines(lines(documents, copies_from), min_words))
    places = cut_lineage(with_possible_partner(classes))
    candidates = cut_lineage(candidate_words(documents, places))
    release(places)
    variants = cut_lineage(deletion_variants(candidates))
    pairs = cut_lineage(near_pairs(variants))
    release(variants)
    gone = cut_lineage(later_lines(candidates, pairs))
    release(candidates, pairs)
    stay = classes.select(*PLACE).join(gone, PLACE, "left_anti")
    kept = F.sort_array(F.collect_list("line"))
    # Zeros up to each kept line, then a one.
    flags = F.array_join(
        F.expr(
            "transform(kept, (k, i) ->"
            " concat(repeat('0', k - if(i = 0, 0, kept[i - 1] + 1)), '1'))"
        ),
        "",
    )
    return (
        stay.groupBy("doc", "version")
        .agg(kept.alias("kept"))
        .select("doc", "version", flags.cast("binary").alias("flags"))
    )


def repeats_marked(keyed: DataFrame) -> DataFrame:
    """Rows with ``_repeat``: whether another row of the same ``_doc`` and ``_version`` is the first.

    Only rows that are repeated are numbered, and the numbers are stored, so that a
    task that runs again numbers nothing anew. The first is the least number, which
    is aggregated before it meets the rows: no group is sorted or held by a task.
    """
    place = ["_doc", "_version"]
    counts = keyed.filter(_long_enough(F.col("_row.text"), 1)).groupBy(*place).agg(F.count("*").alias("_n"))
    repeated = cut_lineage(counts.filter("_n > 1").select(*place))
    if repeated.isEmpty():
        return keyed.withColumn("_repeat", F.lit(False))
    also = F.xxhash64(*place)  # a join on it as well can be split at a hot place
    there = repeated.withColumn("_also", also)
    own = keyed.withColumn("_also", also)
    numbered = own.join(there, [*place, "_also"], "left_semi").withColumn("_at", F.monotonically_increasing_id())
    numbered = cut_lineage(numbered)
    firsts = numbered.groupBy(*place).agg(F.min("_at").alias("_first")).withColumn("_also", also)
    marked = numbered.join(firsts, [*place, "_also"]).withColumn("_repeat", F.col("_at") != F.col("_first"))
    others = own.join(there, [*place, "_also"], "left_anti").withColumn("_repeat", F.lit(False))
    names = [*keyed.columns, "_repeat"]
    return others.select(*names).unionByName(marked.select(*names))


def deduped(
    documents: DataFrame, min_words: int = MIN_WORDS, copies_from: int = 1
) -> DataFrame:
    """The documents with ``text`` cleaned, and how many lines were compared and went.

    Adds ``_compared`` and ``_gone``; all columns of ``documents`` stay.
    """
    kept = kept_places(documents, min_words, copies_from)
    # Rows travel as one column, so that no name of theirs meets a name used here.
    keyed = repeats_marked(
        documents.select(F.struct("*").alias("_row"))
        .withColumn("_doc", _ordered(F.col("_row.doc_id"), documents.schema["doc_id"].dataType))
        .withColumn("_version", F.xxhash64("_row.text"))
    )
    kept = kept.select(
        F.col("doc").alias("_doc"), F.col("version").alias("_version"), F.col("flags").alias("_flags")
    )
    judged = F.transform(
        F.split("_row.text", "\n"),
        lambda line, at: F.struct(
            line.alias("line"),
            _long_enough(line, copies_from).alias("compared"),
            at.alias("at"),
        ),
    )
    staying = F.expr(
        "filter(_lines, x -> not x.compared"
        " or not _repeat and coalesce(substring(_flags, x.at + 1, 1) = X'31', false))"
    )
    text = F.when(F.col("_row.text").isNotNull(), F.array_join("_staying.line", "\n"))
    return (
        keyed.join(kept, ["_doc", "_version"], "left")
        .withColumn("_lines", judged)
        .withColumn("_staying", staying)
        .select(
            F.col("_row").withField("text", text).alias("_row"),
            F.coalesce(F.expr("size(filter(_lines, x -> x.compared))"), F.lit(0)).alias("_compared"),
            F.coalesce(F.size("_lines") - F.size("_staying"), F.lit(0)).alias("_gone"),
        )
        .select("_row.*", "_compared", "_gone")
    )


def op6_line_dedup(spark, sf_dir: str) -> DataFrame:
    """All documents: their lines compared and gone, and a digest of what stays."""
    cleaned = deduped(take(spark.read.parquet(f"{sf_dir}/documents.parquet"), doc_id="doc_id", text="text"))
    return cleaned.select(
        "doc_id",
        F.col("_compared").cast("long").alias("n_compared"),
        F.col("_gone").cast("long").alias("n_gone"),
        F.md5("text").alias("cleaned_md5"),
    )


OP6_SQL = r"""
with numbered as (
  select *, row_number() over (order by doc_id nulls first, text) as rid from documents
),
pieces as (
  select rid, unnest(string_split(text, chr(10))) as line,
    generate_subscripts(string_split(text, chr(10)), 1) as line_no
  from numbered where text is not null
),
named as (
  select *, regexp_extract_all(line, '[^\x20\x09-\x0D]+') as words from pieces
),
long as (
  select rid, line_no, line, words, len(words) as n, array_to_string(words, ' ') as content,
    row_number() over (order by rid, line_no) as place
  from named where len(words) >= 1
),
firsts as (
  select content, min(place) as place, any_value(words) as words, any_value(n) as n
  from long group by content
),
variants as (
  select place, n, k, array_to_string(words[:k - 1] || words[k + 1:], ' ') as variant
  from (select place, n, words, unnest(range(1, n + 1)) as k from firsts where n >= 5)
),
replaced as (
  select place from (
    select place, min(place) over (partition by variant, k, n) as earliest from variants
  ) where earliest < place
),
inserted as (
  select greatest(v.place, f.place) as place
  from variants v join firsts f on f.content = v.variant and f.n = v.n - 1 and f.n >= 5
),
staying as (
  select place from firsts
  where place not in (select place from replaced union all select place from inserted)
),
flagged as (
  select p.rid, p.line_no, p.line, len(p.words) >= 1 as compared,
    len(p.words) < 1 or s.place is not null as stays
  from named p left join long l on l.rid = p.rid and l.line_no = p.line_no
  left join staying s on s.place = l.place
)
select d.doc_id, coalesce(x.n_compared, 0) as n_compared, coalesce(x.n_gone, 0) as n_gone,
  case when d.text is null then null else md5(coalesce(x.cleaned, '')) end as cleaned_md5
from numbered d left join (
  select rid, count(*) filter (compared) as n_compared, count(*) filter (not stays) as n_gone,
    string_agg(line, chr(10) order by line_no) filter (stays) as cleaned
  from flagged group by rid
) x on x.rid = d.rid
"""
