"""Personal data and the terms that give it away.

Patterns find the protected entities: addresses of mail and network, card and phone numbers.  A term
(a word of letters) may reveal one without holding it.  Documents are the events: with df documents of N
holding the entity c or the term t, and both of them where t stands in a context of c (``WINDOW`` words on
either side, from ``REACH`` characters at most), the information that t gives about c is
PMI = log(N df(t,c) / (df(t) df(c))), and all there is to know is IC = log(N / df(c)).  Their ratio is
the disclosure; it is 1 where a term occurs only near c.  A term that is seen with c in ``SUPPORT`` different
contexts (copies of a context count once) and discloses ``DISCLOSED`` or more of some entity is marked
wherever it occurs, in a document with the entity or not; ``sanitised`` generalises it to the kind of
the entity, or removes it from ``REMOVED`` on.

Everything is a DataFrame expression.  The texts are read three times: for the entities with their
contexts (rows in proportion to the entities), for the words (of which only candidate terms go
further), and for the result; none of this shuffles a text unless the marked terms of all documents
exceed ``BROADCAST_CHARS``.

Defined cases: a null text is an empty one, which holds nothing; repeated rows count each and get equal
spans; rows with a null id are found by their text; ties of disclosure go to the kind and entity that
sort first; very long texts are read whole; empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

KINDS = ("email", "ip", "card", "phone")
#: The patterns of the contract, written so that a long text is gone through once: possessive, and starting where a stretch starts.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
WORD = r"[\p{L}\p{M}]+"
WINDOW = 8
REACH = 200
SUPPORT = 3
DISCLOSED = 0.9
REMOVED = 0.999
#: Up to this many characters of ids, terms and hashes are sent to all executors.
BROADCAST_CHARS = 16_000_000


def every(text: Column, pattern: str | Column) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern) if isinstance(pattern, str) else pattern, F.lit(0))


def valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) < 3) | ((F.length(F.ltrim(p, F.lit("0"))) == 3) & (F.ltrim(p, F.lit("0")) <= "255")))
    if kind == "card":
        return F.call_function("luhn_check", F.regexp_replace(value, "[ -]", ""))
    if kind == "phone":
        return F.length(F.regexp_replace(value, "[^0-9]", "")).between(9, 15)
    return F.lit(True)


def of_kind(kind: str):
    return lambda x: valid(kind, x["value"])


def located(found: Column, pieces: Column) -> Column:
    """(start, end, value, before, after) of each match, from the matches and the text around them."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start: int, end: int, value: string, before: string, after: string>>").alias("out"))

    def add(acc: Column, i: Column) -> Column:
        value, piece = F.get(found, i), F.get(pieces, i)
        first = acc["at"] + F.length(piece)
        last = first + F.length(value)
        one = F.struct(first.alias("start"), last.alias("end"), value.alias("value"), F.right(piece, F.lit(REACH)).alias("before"), F.left(F.get(pieces, i + 1), F.lit(REACH)).alias("after"))
        return F.struct(last.alias("at"), F.array_append(acc["out"], one).alias("out"))

    none = F.array().cast("array<struct<start: int, end: int, value: string, before: string, after: string>>")
    return F.when(F.size(found) > 0, F.aggregate(F.sequence(F.lit(0), F.size(found) - 1), start, add, lambda acc: acc["out"])).otherwise(none)


def with_entities(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with an array of the valid matches of each kind, in columns of the kinds' names."""
    patterns = {k: F.when(F.contains(text, F.lit("@")), every(F.col(text), p)).otherwise(F.array()) if k == "email" else every(F.col(text), p) for k, p in PATTERNS.items()}
    out = docs.withColumns({f"__found_{k}": c for k, c in patterns.items()})
    out = out.withColumns({f"__pieces_{k}": F.when(F.size(f"__found_{k}") > 0, F.split(F.col(text), p, -1)) for k, p in PATTERNS.items()})
    out = out.withColumns({k: F.filter(located(F.col(f"__found_{k}"), F.col(f"__pieces_{k}")), of_kind(k)) for k in KINDS})
    return out.drop(*[f"__{x}_{k}" for k in KINDS for x in ("found", "pieces")])


def words(text: Column) -> Column:
    """Words of letters in lower case, those in mail addresses left out."""
    return every(F.lower(F.regexp_replace(text, PATTERNS["email"], " ")), WORD)


def same_entity(kind: str, value: Column) -> Column:
    """The entity of a match: letter case and separators make no difference."""
    return F.concat(F.lit(f"{kind}:"), F.lower(value) if kind == "email" else value if kind == "ip" else F.regexp_replace(value, "[^0-9]", ""))


def co_occurrences(found: DataFrame) -> DataFrame:
    """(entity, term, both, holds, near): documents with the entity near the term, with the entity, and with any entity near the term.

    Pairs with too few different contexts are left out.
    """
    near = lambda x: F.struct(F.reverse(F.slice(F.reverse(words(x["before"])), 1, WINDOW)).alias("left"), F.slice(words(x["after"]), 1, WINDOW).alias("right"))
    seen = lambda k: lambda x: F.struct(same_entity(k, x["value"]).alias("entity"), near(x).alias("near"))
    kinds = [F.transform(k, seen(k)) for k in KINDS]
    each = found.select(F.concat(*kinds).alias("at")).where(F.size("at") > 0)
    text, number = F.lit(None).cast("string"), F.lit(None).cast("long")
    row = lambda entity, term, context: F.struct(entity.alias("entity"), term.alias("term"), context.alias("context"))

    def rows(x: Column) -> Column:
        terms = F.filter(F.array_distinct(F.concat(x["near"]["left"], x["near"]["right"])), lambda w: F.length(w) > 1)
        context = F.xxhash64(x["near"])
        listed = F.flatten(F.transform(terms, lambda w: F.array(row(x["entity"], w, number), row(x["entity"], w, context))))
        return F.array_append(listed, row(x["entity"], text, number))

    # once a document: the entity; the entity with a term; these in one context; the term near any entity
    seen = F.flatten(F.transform("at", rows))
    alone = F.transform(F.filter(F.array_distinct(F.transform(seen, lambda x: x["term"])), lambda w: w.isNotNull()), lambda w: row(text, w, number))
    counted = common.cut(each.select(F.explode(F.concat(F.array_distinct(seen), alone)).alias("x")).select("x.*").groupBy("entity", "term", "context").agg(F.count("*").alias("n")))
    pairs = counted.where("term IS NOT NULL AND entity IS NOT NULL").groupBy("entity", "term").agg(F.max(F.when(F.col("context").isNull(), F.col("n"))).alias("both"), F.count("context").alias("contexts"))
    holds = counted.where("term IS NULL").select(F.col("entity").alias("__entity"), F.col("n").alias("holds"))
    near = counted.where("entity IS NULL").select(F.col("term").alias("__term"), F.col("n").alias("near"))
    pairs = pairs.where(F.col("contexts") >= SUPPORT).join(holds, F.col("entity") == F.col("__entity")).join(near, F.col("term") == F.col("__term"))
    return pairs.select("entity", "term", "both", "holds", "near")


def small(frame: DataFrame, chars: int) -> DataFrame:
    """``frame`` sent to all executors where its characters are few."""
    return F.broadcast(frame) if chars <= BROADCAST_CHARS else frame


def revealing(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(term, disclosure, kind) of the marked terms, and (doc_id, h, term): the documents in which candidate terms occur, a row for each document."""
    n = common.cut(texts.agg(F.count("*").alias("n")))
    told = lambda df: F.ln(F.col("n") * F.col("both") / (F.col(df) * F.col("holds"))) / F.ln(F.col("n") / F.col("holds"))
    # a term is in as many documents at least as it is near entities of, so this leaves out none that is marked
    pairs = co_occurrences(with_entities(texts)).crossJoin(F.broadcast(n)).where("holds < n").where(told("near") >= DISCLOSED)
    pairs = common.cut(pairs)
    candidates = common.cut(pairs.select("term").distinct())
    chars = candidates.agg(F.coalesce(F.sum(F.length("term") + 16), F.lit(0))).first()[0]
    held = texts.select("doc_id", "h", F.explode(F.array_distinct(words(F.col("text")))).alias("term"))
    if not chars:  # no candidate: the words need not be read
        held = held.where(F.lit(False))
    held = common.cut(held.join(small(candidates, chars), "term"))
    df = held.groupBy("term").agg(F.count("*").alias("df"))
    scored = pairs.join(df, "term").select("term", "entity", told("df").alias("disclosure"))
    best = scored.where(F.col("disclosure") >= DISCLOSED).groupBy("term").agg(F.max("disclosure").alias("disclosure"), F.min_by("entity", F.struct(-F.col("disclosure"), "entity")).alias("entity"))
    return best.select("term", "disclosure", F.split("entity", ":")[0].alias("kind")), held


def disclosed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, email, ip, card, phone, term): of every row the valid matches of each kind and the marked terms, with start, end and value.

    ``term`` has also the disclosure and the kind of entity of each; matches have the text before and after them.
    """
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    marked, held = revealing(texts)
    marked = common.cut(marked)
    size = marked.agg(F.coalesce(F.sum(F.length("term") + 32), F.lit(0))).first()[0]
    by = held.join(small(marked, size), "term").select("doc_id", "h", F.struct("term", "disclosure", "kind").alias("x")).groupBy("doc_id", "h").agg(F.sort_array(F.collect_set("x")).alias("terms"))
    by = common.cut(by.toDF("__doc", "__h", "terms"))
    chars = by.agg(F.coalesce(F.sum(F.aggregate("terms", F.lit(32).cast("long"), lambda a, x: a + F.length(x["term"]) + 24)), F.lit(0))).first()[0]
    found = with_entities(texts).join(small(by, chars), F.col("doc_id").eqNullSafe(F.col("__doc")) & (F.col("h") == F.col("__h")), "left").drop("__doc", "__h", "h")

    # the forms in which the row's terms are written, as a pattern that passes over mail addresses
    known = F.transform("terms", lambda x: x["term"])
    forms = F.filter(F.array_distinct(every(F.col("text"), WORD)), lambda w: F.array_contains(known, F.lower(w)))
    pattern = F.concat(F.lit(PATTERNS["email"] + r"|(?<![\p{L}\p{M}])(?:"), F.array_join(forms, "|"), F.lit(r")(?![\p{L}\p{M}])"))
    found = found.withColumn("__pattern", F.when(F.col("terms").isNotNull(), pattern))
    found = found.withColumns({"__found": F.when(F.col("__pattern").isNotNull(), every(F.col("text"), F.col("__pattern"))).otherwise(F.array().cast("array<string>")), "__pieces": F.when(F.col("__pattern").isNotNull(), F.split(F.col("text"), F.col("__pattern"), -1))})
    spans = F.filter(located(F.col("__found"), F.col("__pieces")), lambda x: ~F.contains(x["value"], F.lit("@")))
    told = lambda x: F.get(F.filter("terms", lambda t: t["term"] == F.lower(x["value"])), F.lit(0))
    term = F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value"), told(x)["disclosure"].alias("disclosure"), told(x)["kind"].alias("kind")))
    return found.select("doc_id", "text", *KINDS, term.alias("term"))


def sanitised(docs: DataFrame) -> DataFrame:
    """(doc_id, text): entities replaced by their kind in brackets, marked terms by the kind they tell of in angles, or by nothing from ``REMOVED`` on."""
    found = disclosed(docs)
    named = lambda k: lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(f"[{k}]").alias("put"))
    spans = [F.transform(k, named(k)) for k in KINDS]
    terms = F.transform("term", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.when(x["disclosure"] >= REMOVED, "").otherwise(F.concat(F.lit("<"), x["kind"], F.lit(">"))).alias("put")))
    spans = F.array_sort(F.concat(*spans, terms))
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def add(acc: Column, x: Column) -> Column:  # of spans that overlap the first is put in place
        kept = F.substring(F.col("text"), acc["at"] + 1, x["start"] - acc["at"])
        over = x["start"] < acc["at"]
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), F.when(over, acc["out"]).otherwise(F.concat(acc["out"], F.array(kept, x["put"]))).alias("out"))

    done = found.select("doc_id", "text", F.aggregate(spans, begin, add).alias("x"))
    rest = F.substring(F.col("text"), F.col("x.at") + 1, F.length("text"))
    return done.select("doc_id", F.concat(F.array_join("x.out", ""), rest).alias("text"))


def listed(kind: str) -> Column:
    return F.transform(kind, lambda x: F.concat_ws(":", F.lit(kind), x["start"], x["end"]))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities and revealing terms of every document."""
    found = disclosed(common.table(spark, sf_dir, "documents"))
    base = F.concat(*map(listed, KINDS))
    return found.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS], F.sha2(F.array_join(base, ","), 256).alias("base_sha256"),
        F.array_join(F.concat(base, listed("term")), ",").alias("spans"), F.size("term").cast("long").alias("n_term"),
    )


_EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
_BASE = {"email": _EMAIL, "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
_MATCHES = " UNION ALL ".join(f"SELECT rid, {n} AS o, '{k}' AS kind, regexp_extract_all(text, '{p}') AS f, string_split_regex(text, '{p}') AS p FROM d" for n, (k, p) in enumerate(_BASE.items()))
_WORDS = lambda x: f"regexp_extract_all(lower(regexp_replace({x}, '{_EMAIL}', ' ', 'g')), '{WORD}')"
_AT = "cast(list_sum([length(x) FOR x IN p[1:i]]) + coalesce(list_sum([length(x) FOR x IN f[1:i - 1]]), 0) AS bigint)"
ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS rid FROM documents),
m AS (SELECT *, unnest(range(1, len(f) + 1)) AS i FROM ({_MATCHES}) WHERE len(f) > 0),
v AS (SELECT *, f[i] AS value, regexp_replace(f[i], '[^0-9]', '', 'g') AS digits FROM m),
b AS (SELECT rid, o, kind, value, digits, {_AT} AS start, right(p[i], {REACH}) AS before, left(p[i + 1], {REACH}) AS after FROM v WHERE CASE kind
  WHEN 'ip' THEN list_bool_and([length(ltrim(x, '0')) < 3 OR length(ltrim(x, '0')) = 3 AND ltrim(x, '0') <= '255' FOR x IN string_split(value, '.')])
  WHEN 'card' THEN length(digits) BETWEEN 13 AND 19 AND list_sum([CASE WHEN j % 2 = 0 THEN cast(reverse(digits)[j + 1] AS int) ELSE cast(reverse(digits)[j + 1] AS int) * 2 - CASE WHEN cast(reverse(digits)[j + 1] AS int) > 4 THEN 9 ELSE 0 END END FOR j IN range(length(digits))]) % 10 = 0
  WHEN 'phone' THEN length(digits) BETWEEN 9 AND 15 ELSE true END),
c AS (SELECT rid, kind || ':' || CASE kind WHEN 'email' THEN lower(value) WHEN 'ip' THEN value ELSE digits END AS entity, {_WORDS("before")}[-{WINDOW}:] AS l, {_WORDS("after")}[:{WINDOW}] AS r FROM b),
e AS (SELECT entity, count(DISTINCT rid) AS holds FROM c GROUP BY 1),
t AS (SELECT rid, entity, l, r, unnest(list_distinct(l || r)) AS term FROM c),
q AS (SELECT entity, term, count(DISTINCT rid) AS together, count(DISTINCT (l, r)) AS contexts FROM t WHERE length(term) > 1 GROUP BY ALL HAVING contexts >= {SUPPORT}),
h AS (SELECT DISTINCT rid, term FROM (SELECT rid, unnest({_WORDS("text")}) AS term FROM d) JOIN (SELECT DISTINCT term FROM q) USING (term)),
n AS (SELECT count(*) AS n FROM d),
g AS (SELECT term, max(ln(n * together / (df * holds)) / ln(n / holds)) AS disclosure FROM q JOIN e USING (entity) JOIN (SELECT term, count(*) AS df FROM h GROUP BY 1) USING (term), n WHERE holds < n GROUP BY 1 HAVING disclosure >= {DISCLOSED}),
w AS (SELECT rid, f, p, unnest(range(1, len(f) + 1)) AS i FROM (SELECT rid, regexp_extract_all(text, '{_EMAIL}|{WORD}') AS f, string_split_regex(text, '{_EMAIL}|{WORD}') AS p FROM d SEMI JOIN (SELECT rid FROM h SEMI JOIN g USING (term)) USING (rid))),
x AS (SELECT rid, f[i] AS value, {_AT} AS start FROM w WHERE lower(f[i]) IN (SELECT term FROM g)),
a AS (SELECT rid, o, kind, start, start + length(value) AS stop FROM b UNION ALL SELECT rid, 4, 'term', start, start + length(value) FROM x),
s AS (SELECT rid, {", ".join(f"count_if(kind = '{k}') AS n_{k}" for k in (*KINDS, "term"))}, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY o, start) FILTER (o < 4) AS base, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY o, start) AS spans FROM a GROUP BY 1)
SELECT doc_id, {", ".join(f"cast(coalesce(n_{k}, 0) AS bigint) AS n_{k}" for k in (*KINDS, "term"))}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN s USING (rid)
"""
