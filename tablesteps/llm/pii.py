"""Personal data by information-theoretic sanitisation (DataFrame operations only).

1. Base spans: e-mail, IP, card and phone patterns.  Splitting a text at a
   pattern gives the gaps between its matches; a running sum over gaps and
   matches gives their places.
   Secrets (kind ``secret``) are spans of the method: a value that its text
   assigns to the name of a credential, if it carries ``SECRET_BITS`` of
   information by the spread of its own characters, so that words and
   repeated signs are none.  They are replaced, but stand for no person: no
   terms are weighed against them.
2. Protected entities are the values found by the base patterns.  Every word of a document that
   holds an entity is a candidate, wherever it stands.
3. The corpus says how strongly a term reveals an entity: pointwise mutual
   information over documents, divided by the information of the
   entity itself.  1 means that the term stands nowhere without the entity.
   That estimate is as good as its support: with n different texts that
   hold both it counts 1 - 2^-n, so copies of one text prove little.
4. In documents that hold the entity, terms of ``REMOVE`` or more are removed,
   terms of ``GENERALISE`` or more are replaced by their class.

Corpus counts cover every document.  Groups never gather on one key: words and
pairs are counted with partial aggregates, and a very frequent word is only a
counter.  Words of a document are counted once, however many entities it
holds.  Entities that stand in the same texts form one class, and so do
terms, as only those texts decide a pair; terms that stand in one text, or in
too many documents to reach the threshold, are out before any pair is made.
The pairs of classes of one text are dealt in cells of ``CELL`` at most.

Defined results: null counts as empty (no spans).  Rows of equal id and text
have equal results; a null id is an id like others.  Overlapping spans are
all listed; in the cleaned text they are replaced together, by the label of
the first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import quoted, saved

#: Share of an entity's information from which a term is generalised or removed.
GENERALISE = 0.6
REMOVE = 0.9

#: Information of a secret: its length times the entropy of its characters, in bits (16 random hex digits: about 48).
SECRET_BITS = 40.0

#: Pairs of an entity class and a term class of one text that one task compares at most (about).
CELL = 1 << 20

KINDS = ["email", "ip", "card", "phone", "secret", "term"]
LABELS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "secret": "[SECRET]"}

# Patterns fixed by the contract; possessive, and only begun where a run begins, so that they take linear time:
# a run that fails from its begin fails from everywhere in it.  Cards shorter than 14 digits would be dropped anyway.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?:\G|(?<![0-9])(?<![0-9][\x20-]))[0-9](?:[\x20-]?[0-9]){13,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
ANY = "|".join(PATTERNS[k] for k in ("email", "phone", "card", "ip"))
WORD = r"[\p{L}\p{N}]+"
# Names that credentials are assigned to, and what stands between name and value.
NAMED = r"(?i:token|secret|passw(?:or)?d|passphrase|api[_-]?key|access[_-]?key|private[_-]?key|credentials?)[\"']?\s{0,3}[:=]\s{0,3}[\"']?"
SECRET = rf"(?<![A-Za-z0-9_+/.-])(?<={NAMED})[A-Za-z0-9_+/.-]{{12,}}+=*+"


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    turned = F.reverse(digits_of(value))

    def add(total: Column, i: Column) -> Column:
        digit = F.substring(turned, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return total + digit - F.when(digit > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), add) % 10 == 0


def bits_of(value: Column) -> Column:
    """Length times the Shannon entropy of the characters."""
    signs, n = F.split(value, ""), F.length(value)
    times = F.transform(F.array_distinct(signs), lambda c: F.size(F.filter(signs, lambda x: x == c)))
    return F.aggregate(times, F.lit(0.0), lambda total, k: total + k * F.log2(n / k))


def passes(kind: Column, value: Column) -> Column:
    """Whether a match of a kind's pattern counts."""
    n = F.length(digits_of(value))
    parts = F.transform(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
    small = F.forall(parts, lambda p: (F.length(p) <= 3) & (F.when(F.length(p).between(1, 3), p.cast("int")).otherwise(0) <= 255))
    return (
        F.when(kind == "ip", small)
        .when(kind == "card", F.when(n.between(14, 19), luhn(value)).otherwise(False))
        .when(kind == "phone", n.between(10, 15))
        .when(kind == "secret", bits_of(value) >= SECRET_BITS)
        .otherwise(True)
    )


def matches(kind: str, text: Column, pattern: str) -> Column:
    """Every match of a pattern: its number, the length of the gap before it, its text."""
    both = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("value"))
    return F.transform(
        both,
        lambda m, i: F.struct(
            F.lit(kind).alias("kind"), i.alias("i"), F.length(m["gap"]).alias("gap"), m["value"].alias("value")
        ),
    )


def placed(rows: DataFrame) -> DataFrame:
    """``start`` and ``end`` (code points, end exclusive) of matches of (``id``, ``th``, ``kind``)."""
    order = Window.partitionBy("id", "th", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    return (
        rows.filter(F.col("value").isNotNull())
        .dropDuplicates(["id", "th", "kind", "i"])
        .withColumn("end", F.sum(F.col("gap") + F.length("value")).over(order).cast("long"))
        .withColumn("start", F.col("end") - F.length("value"))
        .select("id", "th", "kind", "start", "end", "value")
    )


def entity_of(kind: Column, value: Column) -> Column:
    """One form for the ways to write an entity."""
    return F.concat_ws(":", kind, F.when(kind.isin("card", "phone"), digits_of(value)).otherwise(F.lower(value)))


def base_spans(texts: DataFrame) -> DataFrame:
    """The base spans and secrets of (``id``, ``th``, ``t``): ``kind``, ``start``, ``end``, ``value``."""
    named = F.col("t").rlike(NAMED)
    likely = texts.filter(F.col("t").rlike("[0-9@]") | named)
    none = F.array().cast("array<struct<kind:string,i:int,gap:int,value:string>>")
    secrets = F.coalesce(F.when(named, matches("secret", F.col("t"), SECRET)), none)
    found = F.concat(*[matches(k, F.col("t"), p) for k, p in PATTERNS.items()], secrets)
    rows = likely.select("id", "th", F.explode(found).alias("m")).select("id", "th", "m.*")
    return placed(rows).filter(passes(F.col("kind"), F.col("value")))


def least_support(generalise: float) -> int:
    """How many different texts a pair needs to reach ``generalise`` at all."""
    return next((n for n in range(1, 50) if 1 - 0.5**n >= generalise), 50)


def holders_of(texts: DataFrame, spans: DataFrame, support: int) -> DataFrame:
    """Different texts (``t``, ``copies``) and their ``entities`` that stand in ``support`` or more different texts:
    no term can reveal the others."""
    held = spans.select("th", entity_of(F.col("kind"), F.col("value")).alias("entity")).distinct()
    often = held.groupBy("entity").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= support).select("entity")
    entities = held.join(often, "entity").groupBy("th").agg(F.collect_list("entity").alias("entities"))
    different = texts.filter(F.col("t").rlike(ANY)).groupBy("th").agg(F.count(F.lit(1)).alias("copies"), F.first("t").alias("t"))
    return different.join(entities, "th").select("th", "t", "copies", "entities")


def words_of(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)))


def same_texts() -> Column:
    """One value for all that stand in the same set of texts (different ``th`` in the group): 128 bits of their hashes."""
    return F.struct(F.bit_xor(F.xxhash64("th")).alias("a"), F.bit_xor(F.xxhash64("th", F.lit(1))).alias("b"))


def entity_classes(holders: DataFrame) -> DataFrame:
    """``entity``, ``eclass``, ``n_entity`` (documents that hold it), ``in_texts`` (different ones)."""
    held = holders.select("th", "copies", F.explode("entities").alias("entity"))
    return held.groupBy("entity").agg(
        same_texts().alias("eclass"), F.sum("copies").alias("n_entity"), F.count(F.lit(1)).alias("in_texts")
    )


def most_documents(total: int, n_entity: Column, generalise: float) -> Column:
    """In how many documents a term may stand and still reveal an entity of ``n_entity`` documents by ``generalise``
    (if it stands in all of those); a little more, as the disclosure itself is compared later."""
    n = float(max(total, 2))
    return F.lit(1.001) * F.pow(F.lit(n), F.lit(1 - generalise)) * F.pow(n_entity.cast("double"), F.lit(generalise))


def term_classes(texts: DataFrame, words: DataFrame, most: float, support: int) -> DataFrame:
    """``term``, ``tclass``, ``n_term`` (documents of the corpus) for terms of ``support`` different texts of holders
    that stand in ``most`` documents of the corpus at most."""
    inside = words.groupBy("term").agg(same_texts().alias("tclass"), F.count(F.lit(1)).alias("in_texts"))
    wanted = inside.filter(F.col("in_texts") >= support).select("term", "tclass")
    # Counted before the join: a task sends one row for each of its words, however many are wanted.
    everywhere = texts.select(F.explode(words_of(F.col("t"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n_term"))
    return everywhere.filter(F.col("n_term") <= most).join(wanted, "term")


def class_pairs(entities: DataFrame, terms: DataFrame, cell: int) -> DataFrame:
    """``eclass``, ``tclass``, ``n_both`` (documents that hold both), ``support`` (different texts among them).

    ``entities`` holds ``th``, ``copies``, ``eclass``, ``most``; ``terms`` holds
    ``th``, ``tclass``, ``n_term``.  A text of many classes on both sides is
    dealt in as many cells as keep each below ``cell`` pairs: its terms by
    hash, its entities to every cell.
    """
    sizes = entities.groupBy("th").agg(F.count(F.lit(1)).alias("n")).join(terms.groupBy("th").agg(F.count(F.lit(1)).alias("m")), "th")
    cells = sizes.select("th", F.ceil(F.col("n") * F.col("m") / float(cell)).cast("int").alias("cells"))
    left = entities.join(cells, "th").withColumn("at", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)))
    right = terms.join(cells, "th").withColumn("at", F.pmod(F.xxhash64("tclass.a"), F.col("cells")).cast("int"))
    met = left.alias("l").join(
        right.alias("r"),
        (F.col("l.th") == F.col("r.th")) & (F.col("l.at") == F.col("r.at")) & (F.col("r.n_term") <= F.col("l.most")),
    )
    pairs = met.select("l.eclass", "r.tclass", "l.copies").groupBy("eclass", "tclass")
    return pairs.agg(F.sum("copies").alias("n_both"), F.count(F.lit(1)).alias("support"))


def disclosures(texts: DataFrame, spans: DataFrame, generalise: float, cell: int = CELL) -> tuple[DataFrame, DataFrame]:
    """Terms that reveal entities by ``generalise`` or more of their information: ``eclass``, ``term``,
    ``disclosure``; and the class of each entity: ``entity``, ``eclass``."""
    spark = texts.sparkSession
    support = least_support(generalise)
    holders = saved(spark, holders_of(texts, spans, support), "pii-holders")
    total = texts.count()
    entities = saved(spark, entity_classes(holders), "pii-entities")
    classes = entities.groupBy("eclass").agg(F.first("n_entity").alias("n_entity"))
    classes = classes.withColumn("most", most_documents(total, F.col("n_entity"), generalise))
    most = classes.agg(F.max("most")).first()[0]  # one number
    words = saved(spark, holders.select("th", F.explode(words_of(F.col("t"))).alias("term")), "pii-words")
    terms = saved(spark, term_classes(texts, words, most or 0.0, support), "pii-terms")
    held = holders.select("th", "copies", F.explode("entities").alias("entity")).join(entities.select("entity", "eclass"), "entity")
    held = held.select("th", "copies", "eclass").distinct().join(classes.select("eclass", "most"), "eclass")
    # Terms of one class stand in the same texts, but may differ in the corpus: the rarest of them stands for the bound.
    rarest = words.join(terms, "term").groupBy("th", "tclass").agg(F.min("n_term").alias("n_term"))
    pairs = class_pairs(saved(spark, held, "pii-held"), saved(spark, rarest, "pii-rarest"), cell)
    both = pairs.filter(F.col("support") >= support).join(classes, "eclass").join(terms, "tclass")
    own = F.log(F.lit(float(max(total, 2))) / F.col("n_entity"))
    shared = F.log(F.col("n_both") * F.lit(float(max(total, 2))) / (F.col("n_entity") * F.col("n_term")))
    sure = 1 - F.pow(F.lit(0.5), F.col("support"))
    told = both.withColumn("disclosure", F.when(own > 0, sure * shared / own).otherwise(0.0))
    told = told.filter(F.col("disclosure") >= generalise).select("eclass", "term", "disclosure")
    return told, entities.select("entity", "eclass")


def term_spans(texts: DataFrame, spans: DataFrame, told: DataFrame, entities: DataFrame, remove: float) -> DataFrame:
    """Spans of revealing terms in the documents that hold the entity; ``value`` is what replaces them."""
    wanted = (
        spans.select("id", "th", entity_of(F.col("kind"), F.col("value")).alias("entity"))
        .join(entities, "entity")
        .select("id", "th", "eclass")
        .distinct()
        .join(told, "eclass")
        .groupBy("id", "th", "term")
        .agg(F.max("disclosure").alias("disclosure"))
    )
    holders = wanted.select("id", "th").distinct()
    same = (F.col("l.id").eqNullSafe(F.col("r.id"))) & (F.col("l.th") == F.col("r.th"))
    held = texts.alias("l").join(holders.alias("r"), same, "left_semi")
    rows = held.select("id", "th", F.explode(matches("term", F.col("t"), WORD)).alias("m")).select("id", "th", "m.*")
    words = placed(rows).withColumn("term", F.lower("value"))
    hit = words.alias("l").join(wanted.alias("r"), same & (F.col("l.term") == F.col("r.term")))
    number = F.col("l.value").rlike("^[0-9]+$")
    instead = F.when(F.col("r.disclosure") >= remove, "").when(number, "[number]").otherwise("[word]")
    return hit.select("l.id", "l.th", "l.kind", "l.start", "l.end", instead.alias("value"))


def hashed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(quoted(text_col)).cast("string"), F.lit(""))
    return docs.select(F.col(quoted(id_col)).alias("id"), text.alias("t")).withColumn("th", F.xxhash64("t"))


def find_spans(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    generalise: float = GENERALISE,
    remove: float = REMOVE,
) -> DataFrame:
    """All spans: ``id``, ``th`` (hash of the text), ``kind``, ``start``, ``end``, ``instead`` (what replaces them)."""
    spark = docs.sparkSession
    texts = hashed(docs, id_col, text_col)
    spans = saved(spark, base_spans(texts), "pii-base")
    people = spans.filter(F.col("kind") != "secret")
    told, entities = disclosures(texts, people, generalise)
    terms = term_spans(texts, people, saved(spark, told, "pii-disclosures"), entities, remove)
    labels = F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair])
    base = spans.withColumn("instead", labels[F.col("kind")]).drop("value")
    # A term inside a base span is covered already.
    free = terms.alias("l").join(
        spans.alias("r"),
        F.col("l.id").eqNullSafe(F.col("r.id"))
        & (F.col("l.th") == F.col("r.th"))
        & (F.col("l.start") < F.col("r.end"))
        & (F.col("r.start") < F.col("l.end")),
        "left_anti",
    )
    return saved(spark, base.unionByName(free.withColumnRenamed("value", "instead")), "pii-spans")


def replacements(spans: DataFrame) -> DataFrame:
    """Per text, ``cuts``: disjoint (start, end, instead) by start; overlapping spans joined."""
    by = Window.partitionBy("id", "th").orderBy("start", "end", "kind")
    reach = F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1))
    groups = spans.withColumn("reach", reach).withColumn("new", (F.col("reach").isNull() | (F.col("start") >= F.col("reach"))).cast("int"))
    groups = groups.withColumn("g", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    first = F.min(F.struct("start", "end", "kind", "instead"))
    cuts = groups.groupBy("id", "th", "g").agg(F.min("start").alias("start"), F.max("end").alias("end"), first.alias("f"))
    return cuts.groupBy("id", "th").agg(
        F.array_sort(F.collect_list(F.struct("start", "end", F.col("f.instead").alias("instead")))).alias("cuts")
    )


def sanitise(docs: DataFrame, spans: DataFrame, keep: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``keep`` columns, the counts and digest of the spans, and ``clean``: the text with every span replaced."""
    names = [f"k{i}" for i in range(len(keep))]
    rows = docs.select(
        F.col(quoted(id_col)).alias("id"),
        F.coalesce(F.col(quoted(text_col)).cast("string"), F.lit("")).alias("t"),
        *[F.col(quoted(c)).alias(n) for c, n in zip(keep, names)],
    ).withColumn("th", F.xxhash64("t"))
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    listed = F.array_sort(F.collect_list(F.struct("start", rank.alias("rank"), "end", "kind")))
    per_text = spans.groupBy("id", "th").agg(
        listed.alias("spans"), *[F.count(F.when(F.col("kind") == k, 1)).alias(f"n_{k}") for k in KINDS]
    )
    same = lambda a, b: F.col(f"{a}.id").eqNullSafe(F.col(f"{b}.id")) & (F.col(f"{a}.th") == F.col(f"{b}.th"))
    found = per_text.alias("p").join(replacements(spans).alias("c"), same("p", "c")).select("p.*", "c.cuts")
    joined = rows.alias("d").join(found.alias("f"), same("d", "f"), "left").select(
        *[f"d.{n}" for n in names], "d.t", "f.spans", "f.cuts", *[f"f.n_{k}" for k in KINDS]
    )

    def shown(items: Column) -> Column:
        return F.array_join(
            F.transform(items, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
        )

    ends = F.transform("cuts", lambda c: c["end"])
    before = F.concat(F.array(F.lit(0).cast("long")), F.slice(ends, 1, F.size(ends) - 1))
    pieces = F.transform(
        F.arrays_zip(F.col("cuts").alias("cut"), before.alias("from")),
        lambda x: F.concat(
            F.substring(F.col("t"), (x["from"] + 1).cast("int"), (x["cut"]["start"] - x["from"]).cast("int")), x["cut"]["instead"]
        ),
    )
    tail = F.substring(F.col("t"), (F.element_at(ends, -1) + 1).cast("int"), F.length("t"))
    clean = F.when(F.col("cuts").isNull(), F.col("t")).otherwise(F.concat(F.array_join(pieces, ""), tail))
    none = F.lit("")
    out = joined.select(
        *names,
        *[F.coalesce(F.col(f"n_{k}"), F.lit(0)).cast("long") for k in KINDS],
        F.coalesce(shown(F.filter("spans", lambda s: s["kind"].isin(*PATTERNS))), none),
        F.coalesce(shown(F.col("spans")), none),
        clean,
    )
    return out.toDF(*keep, *[f"n_{k}" for k in KINDS], "base_spans", "spans", "clean")
