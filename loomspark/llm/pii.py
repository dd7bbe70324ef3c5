"""Personal data: fixed kinds, and terms that disclose them (operator 2). DataFrame operations only.

E-mail addresses, IP addresses, card numbers and phone numbers are found by pattern and verified. Each distinct value is a
protected entity. For the terms near an entity (``CONTEXT`` code points on either side), corpus co-occurrence tells how
far a term gives it away: a term discloses an entity if their pointwise mutual information reaches ``DISCLOSURE`` of the
entity's own information. Every pair is judged, however few texts have it. Such a term is sanitised wherever it stands in
a document that holds the entity. Document frequencies of candidate terms count every word of every text.

Matches leave a text as one array; places come from running sums over its rows, and terms meet spans by cells of the text,
so the work is linear in the matches and words of a document, however long it is. Entities, terms and pairs are counted with
map-side combination; a value that a third of all documents hold is one row of each table.

Edge cases: a null text is empty; an empty text has no spans, and its digest is that of the empty string; a very long text,
or one with very many matches, is treated as any other; repeated rows are judged alike and each counts as a document; spans
of different kinds may overlap, and of overlapping ones sanitising writes one tag, that of the first by start, then kind;
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspark.llm._store import Tables, free_name, if_small

KINDS = ("email", "ip", "card", "phone")
TERM = "term"
#: As matched, possessive where no retry can succeed, so that long runs stay linear.
PATTERNS = (
    r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    r"[0-9](?:[ -]?[0-9])++",
    r"\+[0-9][ ().0-9-]+[0-9]",
)
#: A text that fails it has no match that would be kept.
NEEDS = ("instr({t}, '@') > 0", "{t} rlike '[0-9]\\\\.[0-9]'", "{t} rlike '[0-9](?:[ -]?[0-9]){{13}}'", "instr({t}, '+') > 0")
CONTEXT, DISCLOSURE = 48, 0.9
WORD = r"[\p{L}\p{N}]{3,}"
#: Code points of a text that are rewritten together.
BLOCK = 1024
#: Cells in which terms and spans meet; a context reaches into two.
CELL = 64


def matches(text: str, pattern: str, valid: str = "true") -> str:
    """SQL: for each match of a pattern that doesn't match the empty string, the code points before it, itself, and its validity."""
    quoted = pattern.replace("\\", "\\\\").replace("'", "\\'")
    return f"""transform(filter(
        zip_with(regexp_extract_all({text}, '{quoted}', 0), transform(split({text}, '{quoted}', -1), g -> char_length(g)), (m, g) -> struct(g as gap, m as value)),
        x -> x.value is not null), x -> struct(x.gap as gap, x.value as value, {valid} as valid))"""


def _digits(value: str) -> str:
    return f"regexp_replace({value}, '[^0-9]', '')"


def _luhn(value: str) -> str:
    d = _digits(value)
    # reverse('5') is '5': places count from the right, and every second digit is doubled.
    return f"""aggregate(sequence(1, char_length({d})), 0, (a, i) -> a + element_at(
        if(i % 2 = 1, array(0, 1, 2, 3, 4, 5, 6, 7, 8, 9), array(0, 2, 4, 6, 8, 1, 3, 5, 7, 9)),
        cast(substring(reverse({d}), i, 1) as int) + 1)) % 10 = 0"""


VALID = (
    "true",
    r"forall(split(x.value, '\\.'), p -> char_length(ltrim('0', p)) <= 3 and coalesce(cast(nullif(substring(ltrim('0', p), 1, 3), '') as int), 0) <= 255)",
    f"char_length({_digits('x.value')}) between 14 and 19 and {_luhn('x.value')}",
    f"char_length({_digits('x.value')}) between 10 and 15",
)


#: Stands for a null id where ids are joined on.
NO_ID = -1 << 63
FOUND = "array<struct<gap: int, value: string, valid: boolean>>"


def matched(docs: DataFrame) -> DataFrame:
    """row, doc_id, text_key, found (by kind, the matches) and words (where a match is valid) of each document."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    kinds = ", ".join(f"if({needs.format(t='text')}, {matches('text', pattern, valid)}, cast(array() as {FOUND}))" for pattern, needs, valid in zip(PATTERNS, NEEDS, VALID, strict=True))
    rows = rows.select("row", "doc_id", F.xxhash64("text").alias("text_key"), "text", F.expr(f"array({kinds})").alias("found"))
    some = F.expr("exists(found, k -> exists(k, x -> x.valid))")
    return rows.select("row", "doc_id", "text_key", F.when(some, F.col("found")).alias("found"), F.when(some, F.expr(matches("text", WORD))).alias("words"))


def _located(rows: DataFrame, *by: str) -> DataFrame:
    """start and end of matches with their number i within by."""
    before = Window.partitionBy(*by).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("x.gap") + F.char_length("x.value")).over(before)
    return rows.withColumn("end", end.cast("int")).withColumn("start", F.col("end") - F.char_length("x.value"))


def base_spans(rows: DataFrame) -> DataFrame:
    """row, kind, start, end, value, entity of each span of the fixed kinds."""
    kinds = rows.where("found is not null").select("row", F.posexplode("found").alias("kind", "list"))
    each = _located(kinds.select("row", "kind", F.posexplode("list").alias("i", "x")), "row", "kind").where("x.valid")
    return each.select("row", "kind", "start", "end", F.col("x.value").alias("value"), F.md5(F.concat_ws(":", "kind", "x.value").cast("binary")).alias("entity"))


def located_words(rows: DataFrame) -> DataFrame:
    """row, term, start, end of every word of the documents with spans."""
    words = _located(rows.where("words is not null").select("row", F.posexplode("words").alias("i", "x")), "row")
    return words.select("row", "start", "end", F.lower("x.value").alias("term"))


def _cells(a: str, b: str) -> Column:
    return F.expr(f"sequence(cast(floor(({a}) / {CELL}) as int), cast(floor(({b}) / {CELL}) as int))")


def outside(words: DataFrame, spans: DataFrame) -> DataFrame:
    """The words (row, start, end and other columns) that no span overlaps."""
    taken = spans.select("row", F.col("start").alias("s"), F.col("end").alias("e"), F.explode(_cells("start", "end - 1")).alias("cell"))
    mine = words.select("row", "start", "end").distinct().withColumn("cell", F.explode(_cells("start", "end - 1")))
    within = mine.join(taken, ["row", "cell"]).where("start < e and s < end").select("row", "start").distinct()
    return words.join(within, ["row", "start"], "left_anti")


def nearby(words: DataFrame, spans: DataFrame, tables: Tables) -> DataFrame:
    """row, entity, term, each once, of the words within CONTEXT code points of a span."""
    sides = F.array_distinct(F.concat(_cells(f"start - {CONTEXT}", "start"), _cells("end", f"end + {CONTEXT}")))
    around = tables.written(spans.select("row", "entity", F.col("start").alias("s"), F.col("end").alias("e"), F.explode(sides).alias("cell")), "pii-around")
    met = words.withColumn("cell", F.expr(f"cast(floor(start / {CELL}) as int)")).join(if_small(around), ["row", "cell"])
    met = met.where(f"(start >= s - {CONTEXT} and end <= s) or (start >= e and end <= e + {CONTEXT})").select("row", "start", "end", "entity", "term")
    return outside(tables.written(met, "pii-met"), spans).select("row", "entity", "term").distinct()


def term_frequency(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """In how many documents each wanted term (a written table) occurs; every word of every text is looked at."""
    words = docs.select(F.explode(F.array_distinct(F.expr(f"regexp_extract_all(lower(text), '{WORD.replace(chr(92), chr(92) * 2)}', 0)"))).alias("term"))
    few = if_small(wanted)
    if few is not wanted:  # sent to the words, so that only these are shuffled
        return words.join(few, "term").groupBy("term").agg(F.count("*").alias("df_term"))
    return words.groupBy("term").agg(F.count("*").alias("df_term")).join(wanted, "term")


def disclosing(near: DataFrame, spans: DataFrame, docs: DataFrame, total: int, tables: Tables) -> DataFrame:
    """(entity, term) pairs in which the term gives the entity away."""
    together = tables.written(near.groupBy("entity", "term").agg(F.count("*").alias("both")), "pii-pairs")
    entities = spans.select("row", "entity").distinct().groupBy("entity").agg(F.count("*").alias("df_entity"))
    terms = tables.written(together.select("term").distinct(), "pii-terms")
    judged = together.join(term_frequency(docs, terms), "term").join(entities, "entity")
    information = F.log(F.lit(float(total)) / F.col("df_entity"))
    shared = F.log(F.col("both") * float(total) / (F.col("df_entity") * F.col("df_term")))
    return judged.where((information > 0) & (shared >= DISCLOSURE * information)).select("entity", "term")


def personal_data(docs: DataFrame) -> tuple[DataFrame, DataFrame, Tables]:
    """row, doc_id, text_key of each document; row, kind, start, end of all spans; both written, with the tables to close."""
    tables = Tables()
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = tables.written(matched(texts), "pii-rows")
    spans = tables.written(base_spans(rows), "pii-base")
    words = tables.written(located_words(rows), "pii-words")
    near = tables.written(nearby(words, spans, tables), "pii-near")
    pairs = disclosing(near, spans, texts, rows.count(), tables)
    held = tables.written(spans.select("row", "entity").distinct().join(pairs, "entity").select("row", "term").distinct(), "pii-held-terms")
    terms = outside(tables.written(words.join(if_small(held), ["row", "term"]).select("row", "start", "end"), "pii-terms-found"), spans)
    terms = terms.select("row", F.lit(len(KINDS)).alias("kind"), "start", "end")
    return rows, tables.written(spans.select("row", "kind", "start", "end").unionByName(terms), "pii-spans"), tables


def pii_spans(docs: DataFrame) -> DataFrame:
    """doc_id, a count of each fixed kind, base_sha256 and spans of each document."""
    rows, spans, tables = personal_data(docs)
    tables.close(rows, spans)
    listed = spans.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end"))).alias("all"))
    joined = rows.select("row", "doc_id").join(listed, "row", "left").withColumn("all", F.coalesce("all", F.expr("cast(array() as array<struct<start: int, kind: int, end: int>>)")))
    joined = joined.withColumn("base", F.expr(f"filter(all, x -> x.kind < {len(KINDS)})"))
    counts = [F.expr(f"cast(size(filter(base, x -> x.kind = {k})) as long)").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return joined.select("doc_id", *counts, F.expr(f"sha2({_listed('base')}, 256)").alias("base_sha256"), F.expr(_listed("all")).alias("spans"))


def _listed(spans: str) -> str:
    names = ", ".join(f"'{k}'" for k in (*KINDS, TERM))
    return f"array_join(transform({spans}, x -> concat(element_at(array({names}), x.kind + 1), ':', x.start, ':', x.end)), ',')"


def merged_spans(spans: DataFrame) -> DataFrame:
    """row, start, end, kind: overlapping spans are one, of the kind of the first."""
    order = Window.partitionBy("row").orderBy("start", "kind")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("new", (F.col("start") >= F.coalesce(reach, F.lit(0))).cast("int"))
    marked = marked.withColumn("part", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy("row", "part").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min(F.struct("start", "kind")).alias("first")).select("row", "start", "end", "first.kind")


def sanitise(docs: DataFrame) -> DataFrame:
    """The rows of docs with every span generalised to a tag of its kind; n_chars, where there is one, is counted anew.

    Documents without a span stay where they are; those with spans are rewritten in blocks of ``BLOCK`` code points.
    """
    rows, spans, tables = personal_data(docs)
    id_, key, text = (free_name(c, *docs.columns) for c in ("_pii_id", "_pii_key", "_pii_text"))
    names = ", ".join(f"'<{k.upper()}>'" for k in (*KINDS, TERM))
    cut = merged_spans(spans).select("row", "start", "end", "kind", F.expr(f"explode(sequence(cast(floor(start / {BLOCK}) as int), cast(floor((end - 1) / {BLOCK}) as int)))").alias("b"))
    lo, hi = f"greatest(0, start - b * {BLOCK})", f"least({BLOCK}, end - b * {BLOCK})"
    tag = f"if(floor(start / {BLOCK}) = b, element_at(array({names}), kind + 1), '')"
    cut = cut.groupBy("row", "b").agg(F.array_sort(F.collect_list(F.expr(f"struct({lo} as lo, {hi} as hi, {tag} as tag)"))).alias("cuts"))
    # Rows that repeat a document are rewritten once.
    held = rows.where("found is not null").select("row", F.coalesce("doc_id", F.lit(NO_ID)).alias(id_), F.col("text_key").alias(key))
    held = tables.written(held.groupBy(id_, key).agg(F.min("row").alias("row")), "pii-held")
    keys = [F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias(id_), F.xxhash64("text").alias(key)]
    texts = docs.where("text is not null").select(*keys, "text").join(if_small(held), [id_, key]).select("row", "text")
    blocks = texts.select("row", F.posexplode(F.expr(f"regexp_extract_all(text, '(?s).{{1,{BLOCK}}}', 0)")).alias("b", "block")).distinct().join(cut, ["row", "b"], "left")
    rewritten = F.expr("""if(cuts is null, block, aggregate(cuts, struct(0 as at, cast(array() as array<string>) as out),
        (a, s) -> struct(s.hi as at, concat(a.out, array(substring(block, a.at + 1, s.lo - a.at), s.tag)) as out),
        a -> concat(array_join(a.out, ''), substring(block, a.at + 1))))""")
    clean = blocks.select("row", "b", rewritten.alias("block")).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("b", "block"))).alias("parts"))
    clean = clean.select("row", F.expr("array_join(transform(parts, x -> x.block), '')").alias(text)).join(held, "row").select(id_, key, text)
    clean = tables.written(clean, "pii-texts")
    tables.close(clean, held)
    keyed = docs.withColumns({id_: F.coalesce(docs["doc_id"].cast("long"), F.lit(NO_ID)), key: F.xxhash64(docs["text"])})
    untouched = keyed.join(if_small(held.select(id_, key)), [id_, key], "left_anti").select(*docs.columns)
    change = {"text": F.col(text)} | ({"n_chars": F.char_length(text)} if "n_chars" in docs.columns else {})
    changed = keyed.join(if_small(held.select(id_, key)), [id_, key], "left_semi").join(clean, [id_, key])
    changed = changed.select(*(change[c].cast(docs.schema[c].dataType).alias(c) if c in change else F.col(c) for c in docs.columns))
    return untouched.unionByName(changed)


def op2_pii_sanitisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
