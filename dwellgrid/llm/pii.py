"""Personal data: found by form, and by how much a word gives away about it.

Four kinds are found by their form. The words of a text that holds a value (the protected entity) are
counted with that value, wherever they stand. Over the whole corpus, the pointwise mutual information of
a word and an entity, as a share of the information the entity itself carries, says how far the word alone
discloses it: 1 means that whoever reads the word knows the entity. Words above the thresholds are found
too, in the texts that hold the entity, and are generalised or removed with it.

Everything is DataFrame expressions; no Python runs on the executors.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dwellgrid.llm.common import identified, quoted
from dwellgrid.session import materialize

# The forms. Possessive repeats find the same as greedy ones here, without a stack that grows with the text.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9]){12,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone")

#: The shortest word that is looked at.
WORD = r"\p{L}{3,}"
#: A word discloses an entity if it takes this share of its information and stands with it in so many different texts.
GENERALISE, REMOVE, SUPPORT = 0.8, 0.95, 3
BLOCK = 32

SPAN = "array<struct<kind:string,start:int,stop:int,value:string>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def total(lengths: Column) -> Column:
    return F.aggregate(lengths, F.lit(0), lambda a, x: a + x)


def before(lengths: Column, levels: int = 3) -> Column:
    """For each element the sum of those before it: the blocks before its own, found alike, and the rest of its block.

    With three levels the steps grow with the elements up to some ten million of them.
    """
    if not levels:
        return let(lengths, lambda all_: F.transform(all_, lambda _, i: total(F.slice(all_, F.lit(1), i))))
    block = lambda i: F.floor(i / BLOCK).cast("int")

    # Whatever an inner function reads is bound first: an expression there would be worked out for each element.
    def placed(all_: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(all_)), lambda i: (i < F.size(all_)) & (i % BLOCK == 0))
        sums = F.transform(starts, lambda i: total(F.slice(all_, i + 1, F.lit(BLOCK))))
        own = lambda i: total(F.slice(all_, block(i) * BLOCK + 1, i % BLOCK))
        return let(before(sums, levels - 1), lambda ahead: F.transform(all_, lambda _, i: F.get(ahead, block(i)) + own(i)))

    return let(lengths, placed)


def found(text: Column, pattern: Column, kind: Column, keep: Callable[[Column], Column]) -> Column:
    """Matches of a pattern as spans in code points: what lies between the matches gives their places."""
    size = lambda parts: F.transform(parts, lambda p: F.length(p))

    def placed(hits: Column) -> Column:
        # Between two hits lies a piece of the split: the start of a hit is what the pieces up to it and the hits before it measure.
        def spans(at: Column) -> Column:
            def span(h: Column, i: Column) -> Column:
                return let(
                    F.get(at["gaps"], i) + F.get(at["lengths"], i) + F.get(at["own"], i),
                    lambda start: F.struct(kind.alias("kind"), start.alias("start"), (start + F.length(h)).alias("stop"), h.alias("value")),
                )

            return F.transform(hits, span)

        return let(
            size(F.split(text, pattern, -1)),
            lambda lengths: let(F.struct(before(lengths).alias("gaps"), before(size(hits)).alias("own"), lengths.alias("lengths")), spans),
        )

    none = F.array().cast(SPAN)
    hits = F.regexp_extract_all(text, pattern, F.lit(0))
    return let(hits, lambda h: F.when(F.size(h) == 0, none).otherwise(F.filter(placed(h), lambda s: keep(s["value"])).cast(SPAN)))


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """The check digit of a card number of 13 to 19 digits."""

    def add(number: Column) -> Callable[[Column, Column], Column]:
        def one(acc: Column, i: Column) -> Column:
            digit = F.substring(number, F.length(number) - i, F.lit(1)).cast("int") * (1 + i % 2)
            return acc + F.when(digit > 9, digit - 9).otherwise(digit)

        return one

    return let(
        digits(value),
        lambda d: F.when(
            F.length(d).between(13, 19),
            F.aggregate(F.sequence(F.lit(0), F.length(d) - 1), F.lit(0), add(d)) % 10 == 0,
        ).otherwise(False),
    )


def small_parts(value: Column) -> Column:
    """All four parts at most 255; leading zeros count for nothing."""
    return F.forall(F.split(F.regexp_replace(value, r"(^|\.)0+(?=[0-9])", "$1"), r"\."), lambda p: (F.length(p) <= 3) & (F.lpad(p, 3, "0") <= "255"))


def base_spans(text: Column) -> Column:
    """Spans of the four kinds, kind after kind, each in text order."""
    always = lambda value: F.lit(True)
    none = F.array().cast(SPAN)
    only = lambda sign, spans: F.when(F.contains(text, F.lit(sign)), spans).otherwise(none)
    return F.concat(
        only("@", found(text, F.lit(EMAIL), F.lit("email"), always)),
        only(".", found(text, F.lit(IP), F.lit("ip"), small_parts)),
        found(text, F.lit(CARD), F.lit("card"), luhn),
        only("+", found(text, F.lit(PHONE), F.lit("phone"), lambda v: F.length(digits(v)).between(9, 15))),
    )


def words(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)))


def disclosing(rows: DataFrame, holders: DataFrame) -> DataFrame:
    """``kind, value, term, share`` of the words that disclose an entity.

    ``rows`` are all texts, ``holders`` the different texts with ``key``, ``text``, ``spans`` and ``copies``.
    """
    has = holders.select("key", "copies", F.explode("spans").alias("s")).select("key", "copies", "s.kind", "s.value").distinct()
    entities = has.groupBy("kind", "value").agg(F.sum("copies").alias("n_entity"), F.count("*").alias("texts")).where(F.col("texts") >= SUPPORT).drop("texts")
    counted = rows.select(F.explode(words(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n_term"))
    size = rows.agg(F.count("*").alias("n"))  # one row
    # A share of GENERALISE needs log(n_term / n_both) <= (1 - GENERALISE) log(n / n_entity), and n_both <= n_entity.
    most = F.col("n_entity") * F.pow(F.col("n") / F.col("n_entity"), F.lit(1 - GENERALISE)) * (1 + 1e-9)
    entities = entities.join(F.broadcast(size)).where(F.col("n_entity") < F.col("n")).withColumn("most", most)
    held = materialize(has.join(entities, ["kind", "value"]), "held")
    limits = held.groupBy("key").agg(F.max("most").alias("most"))
    said = holders.join(limits, "key").select("key", "most", F.explode(words(F.col("text"))).alias("term"))
    known = said.groupBy("term").agg(F.count("*").alias("texts"), F.max("most").alias("most")).where(F.col("texts") >= SUPPORT)
    rare = known.join(counted, "term").where(F.col("n_term") <= F.col("most")).select("term", "n_term")
    kept = said.join(rare, "term").where(F.col("n_term") <= F.col("most")).select("key", "term", "n_term")
    pairs = held.join(kept, "key").where(F.col("n_term") <= F.col("most")).groupBy("kind", "value", "term")
    scored = (
        pairs.agg(
            F.sum("copies").alias("n_both"), F.count("*").alias("texts"),
            F.first("n_term").alias("n_term"), F.first("n_entity").alias("n_entity"), F.first("n").alias("n"),
        )
        .where(F.col("texts") >= SUPPORT)
        .withColumn("share", 1 - F.log2(F.col("n_term") / F.col("n_both")) / F.log2(F.col("n") / F.col("n_entity")))
    )
    return scored.where(F.col("share") >= GENERALISE).select("kind", "value", "term", "share")


def term_spans(rows: DataFrame, holders: DataFrame) -> DataFrame:
    """``key, terms``: spans of disclosing words in the texts that hold their entity; the base spans stay whole."""
    terms = disclosing(rows, holders)
    has = holders.select("key", F.explode("spans").alias("s")).select("key", "s.kind", "s.value").distinct()
    wanted = has.join(terms, ["kind", "value"]).groupBy("key", "term").agg(F.max("share").alias("share"))
    pattern = F.concat(F.lit(r"(?iu)(?<!\p{L})\Q"), F.col("term"), F.lit(r"\E(?!\p{L})"))
    kind = F.when(F.col("share") >= REMOVE, "removed").otherwise("generalised")
    spans = wanted.join(holders, "key").select("key", F.explode(found(F.col("text"), pattern, kind, lambda v: F.lit(True))).alias("t"), "spans")
    free = spans.where(~F.exists("spans", lambda s: (s["start"] < F.col("t.stop")) & (F.col("t.start") < s["stop"])))
    return free.groupBy("key").agg(F.array_sort(F.collect_set("t")).alias("terms"))


def with_base(docs: DataFrame, key: str, value: str) -> DataFrame:
    """``doc_id, key, spans, text``: the text only where there are spans, the key a digest of the text."""
    rows = identified(docs, key, value).select("doc_id", "text", base_spans(F.col("text")).alias("spans"))
    return rows.select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("key"), "spans", F.when(F.size("spans") > 0, F.col("text")).alias("text"))


def holders_of(base: DataFrame) -> DataFrame:
    held = base.where(F.col("text").isNotNull())
    return held.groupBy("key").agg(F.first("text").alias("text"), F.first("spans").alias("spans"), F.count("*").alias("copies"))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def _same(kind: str) -> Callable[[Column], Column]:
    return lambda k: F.when(k == kind, 1).otherwise(0)


def find(docs: DataFrame, key: str = "doc_id", value: str = "text") -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans`` of every whole text.

    Null and empty texts hold nothing; equal or null keys give a row each; equal texts have equal spans;
    other columns are ignored; no rows give no rows. Finds are stored once (with the texts that hold any)
    in the shared folder; the words of all texts are counted before they are shuffled.
    """
    base = materialize(with_base(docs, key, value), "pii")
    holders = holders_of(base)
    rows = identified(docs, key, value)
    terms = term_spans(rows, holders)
    full = base.join(terms, "key", "left")
    none = F.array().cast(SPAN)
    kinds = F.transform("spans", lambda s: s["kind"])
    counts = [F.size(F.array_remove(F.transform(kinds, _same(k)), 0)).cast("long").alias(f"n_{k}") for k in KINDS]
    every = F.concat(F.col("spans"), F.coalesce(F.col("terms"), none))
    return full.select("doc_id", *counts, F.sha2(joined(F.col("spans")), 256).alias("base_sha256"), joined(every).alias("spans"))


LABELS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "generalised": "[TERM]", "removed": ""}


def masked(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its label; of overlapping spans the first label stands for all."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(acc: Column, s: Column) -> Column:
        label = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv]), s["kind"]), F.lit(""))
        fresh = s["start"] >= acc["at"]
        out = F.when(fresh, F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), label)).otherwise(acc["out"])
        return F.struct(out.alias("out"), F.greatest(acc["at"], s["stop"]).alias("at"))

    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), s["kind"].alias("kind"))))
    return F.aggregate(ordered, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))


def sanitise(docs: DataFrame, key: str = "doc_id", value: str = "text", letters: str | None = None) -> DataFrame:
    """The documents with all their columns, personal data and disclosing words replaced in ``value``.

    Texts without finds pass unchanged. ``letters`` names a column that is set to the new length.
    """
    base = materialize(with_base(docs, key, value), "pii")
    terms = term_spans(identified(docs, key, value), holders_of(base)).withColumnsRenamed({"key": "__key", "terms": "__terms"})
    text = F.coalesce(quoted(value), F.lit(""))
    marked = docs.withColumn("__spans", base_spans(text))
    rest = marked.where(F.size("__spans") == 0).drop("__spans")
    held = marked.where(F.size("__spans") > 0).withColumn("__key", F.sha2(text.cast("binary"), 256)).join(terms, "__key", "left")
    every = F.concat(F.col("__spans"), F.coalesce(F.col("__terms"), F.array().cast(SPAN)))
    held = held.withColumn(value, masked(quoted(value), every))
    if letters is not None:
        held = held.withColumn(letters, F.length(quoted(value)).cast(docs.schema[letters].dataType))
    return rest.unionByName(held.select(*[quoted(c) for c in docs.columns]))
