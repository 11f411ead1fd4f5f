"""Relational operators over ledgers: repetition, divergence, comparison, work queues, gates, metrics."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgate.functions import lexicon as lx
from quillgate.functions.rules import settle

from .classify import BUCKETS, bucket, risky_unresolved
from .joins import join_groups
from .lineage import cut
from .numbering import number_within

_c = F.col

# Lead-ins of repeated posts, and words without weight
LEAD_INS = [
    r"^\[[^\]]+\]\s+",
    r"^(?:a|an|the)\s+(?:first|second|third|another)\s+(?:social\s+)?(?:account|post)\s+(?:says|claimed|claims|repeats|repeated)\s+that\s+",
    r"^(?:a|an|the)\s+(?:social\s+)?(?:account|post)\s+(?:says|claimed|claims|repeats|repeated)\s+",
    r"^(?:another|second|third)\s+account\s+(?:says|claimed|claims|repeats|repeated)\s+",
]
LIGHT_WORDS = ["a", "an", "the", "that", "this", "so", "and"]
FUZZY_TYPES = ["reported_claim", "opinion_or_frame", "unverified_causality", "rumor", "unobservable"]
EXACT_FLAGS = ["repetition_without_lineage", "source_laundering_risk"]
FUZZY_FLAGS = [*EXACT_FLAGS, "fuzzy_variant_grouped"]
BUNDLE_FLAGS = ["bundle_repetition_without_lineage", "bundle_source_laundering_risk"]
EXACT_NOTE = "Repeated text was detected; v0 does not treat repetition as independent corroboration."
FUZZY_NOTE = "Similar social/community assertion variants were grouped; repetition is not independent corroboration."
FACT_LEVELS = ["report_fact_bucket", "report_observation_bucket"]


def hash16(c: Column) -> Column:
    return F.substring(F.sha2(c, 256), 1, 16)


#: Characters of a text's head for each token asked for, and words that the head must hold beyond these: more than a lead-in has.
HEAD_CHARS, LEAD_WORDS = 24, 8


def _named(c: Column, use: Callable[[Column], Column]) -> Column:
    """use(c), where c is worked out once however often `use` names it."""
    return F.get(F.transform(F.array(c), use), F.lit(0))


def _heavy(text: Column) -> Column:
    out = F.lower(text)
    for p in LEAD_INS:
        out = F.regexp_replace(out, "(?U)" + p, "")
    words = F.split(F.trim(F.regexp_replace(out, r"(?U)[\W_]+", " ")), " ")
    return F.filter(words, lambda w: ~w.isin(*LIGHT_WORDS) & (w != ""))


def variant(text: Column, tokens: int) -> Column:
    """The text without lead-ins, punctuation and light words, cut to its first tokens.

    They are looked for in the text's head.  The whole text is taken apart only where its head may not give them: if it has
    too few words, begins with a bracket, which may close far behind, or holds a capital sigma, whose small form depends on
    what follows."""
    most = HEAD_CHARS * tokens

    def words(t: Column) -> Column:
        head = F.substring(t, 1, most)
        sure = lambda found: ((F.size(found) > tokens + LEAD_WORDS) & ~head.startswith("[") & ~head.contains("\u03a3")) | (F.length(t) <= most)
        return _named(_heavy(head), lambda found: F.when(sure(found), found).otherwise(_heavy(t)))

    return F.array_join(F.slice(_named(text, words), 1, tokens), " ")


def _some(c: Column) -> Column:
    """The text, or null if it is empty; worked out once."""
    return F.get(F.filter(F.array(c), lambda x: x != ""), F.lit(0))


def claim_key() -> Column:
    plain = F.trim(F.regexp_replace(F.lower("claim_text"), r"(?U)\s+", " "))
    text = F.when(_c("source_type").isin("social", "community"), variant(plain, 24)).otherwise(plain)
    return hash16(F.concat_ws("|", "claim_type", text))


def bucket_counts(claims: DataFrame) -> DataFrame:
    """Claims of every bucket, none left out."""
    spark = claims.sparkSession
    every = spark.createDataFrame([(b,) for b in sorted(BUCKETS.values())], "bucket string")
    counts = claims.groupBy(bucket(_c("claim_type")).alias("bucket")).agg(F.count("*").alias("n"))
    return every.join(counts, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def _exact_groups(claims: DataFrame, run: str, order: str, bounds: list[float] | None) -> DataFrame:
    groups = claims.groupBy(run, "normalized_claim_hash").agg(F.count("*").alias("source_count"), F.min(order).alias("first"))
    groups = number_within(cut(groups), [run], "first", "number", bounds=bounds)
    return groups.withColumn("duplicate_group_id", F.when(_c("source_count") > 1, F.format_string("dup_%03d", "number"))).drop("first", "number")


def exact_repetition(claims: DataFrame, run: str, order: str, bounds: list[float] | None = None) -> DataFrame:
    """Claims with the size of their group of equal normalised text within a run, and its number in order of first
    appearance (numbers count all groups, ids are given to those with more than one).  Group sizes and first
    places are pre-aggregated, so a text repeated very often is no hot window; a null run is a run of its own."""
    return join_groups(claims, cut(_exact_groups(claims, run, order, bounds)), [run, "normalized_claim_hash"], "source_count")


def _crowd_variants() -> Column:
    crowd = _c("source_type").isin("community", "social") & _c("claim_type").isin(FUZZY_TYPES)
    return F.when(crowd, _some(variant(_c("claim_text"), 20)))


def with_variants(claims: DataFrame) -> DataFrame:
    """claims with variant_key: what community and social claims say, other words aside.  What several passes read has it
    before it is stored."""
    return claims if "variant_key" in claims.columns else settle(claims, {"variant_key": _crowd_variants()})


def fuzzy_repetition(claims: DataFrame, run: str, order: str) -> DataFrame:
    """Groups of community and social claims that say the same in other words: run, key, members, first."""
    keyed = with_variants(claims).filter("variant_key is not null")
    return keyed.groupBy(run, "variant_key").agg(F.count("*").alias("members"), F.min(order).alias("first_member")).filter("members > 1")


def with_flags(flags: Column, more: list[str], when: Column) -> Column:
    """The flags, and those of `more` that are not among them, in order."""
    return F.when(when, F.concat(flags, F.array_except(F.array(*map(F.lit, more)), flags))).otherwise(flags)


def repetition_policy(claims: DataFrame, run: str, order: str, bounds: list[float] | None = None) -> DataFrame:
    """Claims after the policy on repetition: duplicate_group_id, source_count, lineage_note, more flags, a low tier
    raised to medium, and at most one independent source for what is repeated.

    Equal texts of a run are a group.  Then variants of what community and social sources say are, unless a member
    has a group already; these are numbered on after the exact groups, and every variant takes a number.
    """
    kept = [c for c in claims.columns if c not in ("source_count", "duplicate_group_id", "lineage_note", "variant_key")]
    claims = with_variants(claims).select(*kept, "variant_key")
    groups = cut(_exact_groups(claims, run, order, bounds))
    rows = cut(join_groups(claims, groups, [run, "normalized_claim_hash"], "source_count"))  # three passes read it
    variants = rows.filter("variant_key is not null").groupBy(run, "variant_key").agg(
        F.count("*").alias("__members"), F.min(order).alias("__first"), F.bool_or(_c("duplicate_group_id").isNotNull()).alias("__taken")
    )
    multiple = groups.filter("duplicate_group_id is not null").groupBy(F.col(run).alias("__run")).agg(F.count("*").alias("__before"))
    variants = number_within(cut(variants), [run], "__first", "__number", bounds=bounds)
    variants = variants.join(multiple, _c(run).eqNullSafe(_c("__run")), "left").drop("__run", "__first")
    fuzzy_id = F.format_string("dup_fuzzy_%03d", _c("__number") + F.coalesce("__before", F.lit(0)))
    variants = cut(variants.withColumn("__fuzzy", F.when((_c("__members") > 1) & ~_c("__taken"), fuzzy_id)).drop("__taken", "__number", "__before"))
    loose = rows.filter("variant_key is null").withColumns({"__members": F.lit(0).cast("long"), "__fuzzy": F.lit(None).cast("string")})
    rows = join_groups(rows.filter("variant_key is not null"), variants, [run, "variant_key"], "__members").unionByName(loose)
    exact, fuzzy = _c("duplicate_group_id").isNotNull(), _c("__fuzzy").isNotNull()
    flags = with_flags(with_flags(_c("risk_flags"), EXACT_FLAGS, exact), FUZZY_FLAGS, fuzzy)
    rows = rows.withColumns(
        {
            "risk_flags": flags,
            "risk_tier": F.when((exact | fuzzy) & (_c("risk_tier") == "low"), "medium").otherwise(_c("risk_tier")),
            "independent_source_count": F.when(exact | fuzzy, F.least("independent_source_count", F.lit(1))).otherwise(_c("independent_source_count")),
            "lineage_note": F.when(exact, EXACT_NOTE).when(fuzzy, FUZZY_NOTE),
            "source_count": F.when(fuzzy, _c("__members")).otherwise(_c("source_count")),
            "duplicate_group_id": F.coalesce("duplicate_group_id", "__fuzzy"),
        }
    )
    return rows.select(*kept, "source_count", "duplicate_group_id", "lineage_note")


def bundle_key() -> Column:
    """What claims share that say the same in a bundle; null for those without a word, and excluded ones."""
    return F.when(_c("claim_type") != "excluded", hash16(_some(variant(_c("claim_text"), 24))))


def keyed(claims: DataFrame) -> DataFrame:
    """claims with bundle_key.  What several passes read has it before it is stored, then none works it out again."""
    return claims if "bundle_key" in claims.columns else settle(claims, {"bundle_key": bundle_key()})


def _shared_variants(claims: DataFrame) -> DataFrame:
    """Groups of more than one claim and source that say the same, numbered by hash; claims are keyed."""
    run = F.coalesce(_c("run_id"), F.lit("")) if "run_id" in claims.columns else _c("source_name")
    order = _c("at") if "at" in claims.columns else _c("claim_text")
    shown = [F.min_by("claim_text", order).alias("example")] if "claim_text" in claims.columns else []
    groups = claims.filter("bundle_key is not null").groupBy(_c("bundle_key").alias("key")).agg(
        F.count("*").alias("claims"),
        F.array_join(F.array_sort(F.collect_set("source_name")), ",").alias("sources"),
        F.count_distinct("source_name").alias("n_sources"),
        F.count_distinct(run).alias("n_runs"),
        *shown,
    )
    groups = groups.filter("claims > 1 and n_sources > 1")
    # The groups that qualify are numbered; ranks within ranges of the hash avoid a single task.
    rank = F.row_number().over(Window.partitionBy("part").orderBy("key"))
    parted = groups.withColumn("part", F.substring("key", 1, 2))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parted.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    numbered = parted.withColumn("rank", rank).join(F.broadcast(starts), "part")  # 256 parts at most
    group_id = F.format_string("bundle_dup_%03d", _c("start") + _c("rank")).alias("group_id")
    return numbered.select(group_id, *groups.columns)


def cross_source_groups(claims: DataFrame) -> DataFrame:
    """Texts that several sources carry: group_id, key, claims, sources, n_sources, n_runs, and the first example (by
    `at`, if there is such a column) if the claims have their text.  Claims without a word, and excluded ones, are in none."""
    return _shared_variants(keyed(claims))


def flag_shared(claims: DataFrame) -> DataFrame:
    """Claims with bundle_duplicate_group_id, and two more flags for those of a group of several sources."""
    rows = keyed(claims)
    groups = _shared_variants(rows).select(_c("key").alias("bundle_key"), _c("group_id").alias("bundle_duplicate_group_id"), _c("claims").alias("__n"))
    rows = join_groups(rows, groups, ["bundle_key"], "__n")
    return rows.withColumn("risk_flags", with_flags(_c("risk_flags"), BUNDLE_FLAGS, _c("bundle_duplicate_group_id").isNotNull())).drop("bundle_key", "__n")


# Amounts and the words of a metric's context
KO_UNITS = {"조": 10**12, "억": 10**8, "만": 10**4, "천": 10**3}
# Possessive, and tried only where a figure begins: no call for each part of an amount, no second look at a long figure.
KO_AMOUNT = r"(?<!\d)(?<!\d,)(?:(?:\d[\d,]*+\s*+[조억만천]\s*+)++원?|\d[\d,]*+\s*+원)"
PERCENT = r"(?<!\d)(\d++(?:\.\d++)?+)\s*+(?:%|percent|퍼센트|프로)"
KO_PARTICLE = r"(?:은|는|이|가|을|를|의|에서|에|으로|로|와|과|도|만|고|며|라고|이라고)$"
KO_STOP = ["이다", "한다", "했다", "있다", "됐다", "라고", "밝혔", "집계", "달했", "기록"]
EN_STOP = ["the", "and", "was", "were", "are", "that", "with", "for", "from", "reported", "said", "told", "after", "about", "this"]
CASUALTY_METRIC = "reported_people_count"
CASUALTY = ["injured", "treated", "casualty", "casualties", "people"]


def is_casualty(text: Column) -> Column:
    low = F.lower(text)
    return low.rlike(r"(?U)\bworkers?\s+(?:were\s+)?affected\b") | low.rlike("|".join(CASUALTY))


#: What a claim needs for an amount or a count: a digit of any script.
FIGURE = r"(?U)\d"
_OTHER_DIGITS = "".join(c for c in map(chr, range(0x80, 0x20000)) if unicodedata.decimal(c, None) is not None)


def _plain(figure: Column) -> Column:
    """The figure in ASCII digits, without commas."""
    return F.translate(figure, _OTHER_DIGITS + ",", "".join(str(unicodedata.decimal(c)) for c in _OTHER_DIGITS))


def _cut_double(x: Column) -> Column:
    """The double, none below zero, cut to a whole number exactly: beyond 63 bits it is even, and put together from two halves."""
    high = (x / 2.0**64).try_cast("bigint")
    low = ((x - high.cast("double") * 2.0**64) / 2).try_cast("bigint")
    both = [F.try_multiply(part.cast("decimal(20,0)"), F.lit(str(by)).cast("decimal(20,0)")) for part, by in ((high, 2**64), (low, 2))]
    return F.when(x < 2.0**63, x.try_cast("bigint").cast("decimal(38,0)")).otherwise(F.try_add(*both).try_cast("decimal(38,0)"))


def magnitude(text: Column) -> Column:
    """The first amount: Korean units, else a percentage times 100, else a number; decimal, cut to a whole number.
    Percentages and numbers are taken as doubles.  Null if there is none, or it has more than 38 digits."""
    korean = F.regexp_extract(text, "(?U)" + KO_AMOUNT, 0)
    numbers = F.regexp_extract_all(korean, F.lit(r"(?U)(\d[\d,]*)\s*([조억만천])"), 1)
    units = F.regexp_extract_all(korean, F.lit(r"(?U)(\d[\d,]*)\s*([조억만천])"), 2)
    whole = lambda s: _plain(s).try_cast("decimal(38,0)")
    worth = F.create_map(*[x for k, v in KO_UNITS.items() for x in (F.lit(k), F.lit(v).cast("decimal(20,0)"))])
    parts = F.zip_with(numbers, units, lambda n, u: F.try_multiply(whole(n), worth[u]).try_cast("decimal(38,0)"))
    summed = F.aggregate(parts, F.lit(0).cast("decimal(38,0)"), lambda a, x: F.try_add(a, x).try_cast("decimal(38,0)"))
    plain = whole(F.regexp_extract(korean, r"(?U)(\d[\d,]*)", 1))
    percent = F.regexp_extract(text, "(?U)" + PERCENT, 1)
    number = F.regexp_extract(text, r"(?U)\d[\d,]*(?:\.\d+)?", 0)
    return (
        F.when(F.size(parts) > 0, summed)
        .when(korean != "", plain)
        .when(percent != "", _cut_double(_plain(percent).try_cast("double") * 100))
        .when(number != "", _cut_double(_plain(number).try_cast("double")))
    )


def amount_key(text: Column) -> Column:
    """A text that equal amounts share: the magnitude, of more than 38 digits the amount as it is written; null without one."""
    written = F.regexp_replace(_plain(shown_amount(text)), r"(?U)\s+|(?<![\d.])0+(?=\d)", "")
    return F.coalesce(magnitude(text).cast("string"), F.when(written != "", written))


def context_key(text: Column) -> Column:
    """The sorted distinct words around the amounts; empty if fewer than two."""
    rest = F.regexp_replace(F.regexp_replace(text, "(?U)" + KO_AMOUNT, " "), r"(?U)\d[\d,]*(?:\.\d+)?\s*(?:%|percent|퍼센트|프로|명|원)?", " ")
    korean = F.transform(F.regexp_extract_all(rest, F.lit("[가-힣]{2,}"), 0), lambda w: F.regexp_replace(w, KO_PARTICLE, ""))
    korean = F.filter(korean, lambda w: (F.length(w) >= 2) & ~w.isin(*KO_STOP))
    english = F.filter(F.regexp_extract_all(F.lower(rest), F.lit("[a-z]{3,}"), 0), lambda w: ~w.isin(*EN_STOP))
    tokens = F.array_sort(F.array_distinct(F.concat(korean, english)))
    return F.when(F.size(tokens) >= 2, F.array_join(tokens, "|")).otherwise("")


def shown_amount(text: Column) -> Column:
    """The first amount as it is written, white space squeezed."""
    korean = F.regexp_extract(text, "(?U)" + KO_AMOUNT, 0)
    percent = F.regexp_extract(text, "(?U)" + PERCENT, 0)
    number = F.regexp_extract(text, r"(?U)\d[\d,]*(?:\.\d+)?", 0)
    return F.trim(F.regexp_replace(F.when(korean != "", korean).when(percent != "", percent).otherwise(number), r"(?U)\s+", " "))


def numeric_divergence(claims: DataFrame) -> DataFrame:
    """Contexts for which several sources give several amounts; casualty claims are left to their own rule."""
    text = _c("claim_text")
    rows = claims.filter((_c("claim_type") != "excluded") & text.rlike(FIGURE) & ~is_casualty(text)).select("source_name", "claim_text")
    rows = settle(rows, {"amount": amount_key(text), "value": shown_amount(text), "context": context_key(text)})
    groups = rows.filter("amount is not null and context <> ''").groupBy("context").agg(
        F.count_distinct("amount").alias("n_values"), F.count_distinct("source_name").alias("n_sources"), F.count("*").alias("claims"),
        F.array_join(F.array_sort(F.collect_set("value")), ", ").alias("shown"), F.array_join(F.array_sort(F.collect_set("source_name")), ", ").alias("sources"),
    )
    return groups.filter("n_values > 1 and n_sources > 1")


def casualty_divergence(claims: DataFrame) -> DataFrame:
    """Events after or by which several sources count differently."""
    low = F.lower("claim_text")
    found = F.regexp_extract(low, r"(?U)\b(?:after|by)\s+(?:the\s+)?([a-z0-9][a-z0-9\s-]{0,80})", 1)
    context = F.trim(F.regexp_replace(F.split(found, "[.;,:]")[0], r"(?U)\s+", " "))
    value = F.replace(F.regexp_extract("claim_text", r"(?U)\b\d+(?:,\d{3})*(?:\.\d+)?\b", 0), F.lit(","), F.lit(""))
    rows = claims.filter((_c("claim_type") != "excluded") & is_casualty(_c("claim_text")))
    rows = rows.select("source_name", value.alias("value"), F.when(context == "", "unscoped").otherwise(context).alias("event")).filter("value <> ''")
    groups = rows.groupBy("event").agg(
        F.array_join(F.array_sort(F.collect_set("value")), ",").alias("reported"), F.count_distinct("value").alias("n_values"), F.count_distinct("source_name").alias("n_sources"),
        F.array_join(F.array_sort(F.collect_set("source_name")), ", ").alias("sources"),
    )
    return groups.filter("n_values > 1 and n_sources > 1")


def compare(before: DataFrame, after: DataFrame) -> DataFrame:
    """Claims by key in two bundles: status (new, disappeared, repeated), still_unresolved."""

    def side(df, name):
        return df.select(claim_key().alias("key"), risky_unresolved().alias("risky")).groupBy("key").agg(F.bool_or("risky").alias(name))

    both = side(before, "risky_before").join(side(after, "risky_after"), "key", "full_outer")
    status = F.when(_c("risky_before").isNull(), "new").when(_c("risky_after").isNull(), "disappeared").otherwise("repeated")
    out = both.withColumn("status", status)
    return out.select("key", "status", ((_c("status") == "repeated") & (_c("risky_before") | _c("risky_after"))).alias("still_unresolved"))


def packet_ids(claims: DataFrame, issue: str, category: Column, order: str, bounds: list[float] | None = None) -> DataFrame:
    """packet_id from issue, category and text; the n-th of equal ids ends in _n.  Copies are numbered by blocks of
    ids, so that a text repeated very often is no hot window."""
    base = F.concat(F.lit("vreq_"), hash16(F.concat_ws("|", issue, category, "normalized_claim_hash")))
    rows = claims.withColumns({"category": category, "base_id": base})
    return number_within(rows, ["base_id"], order, bounds=bounds).withColumn("packet_id", F.when(_c("nth") > 1, F.concat_ws("_", "base_id", _c("nth").cast("string"))).otherwise(_c("base_id")))


def gate_violations(claims: DataFrame, entity: str) -> DataFrame:
    """One row for each claim and rule that it breaks."""
    has = lambda *f: F.arrays_overlap(_c("risk_flags"), F.array(*map(F.lit, f)))
    fact, crowd = _c("claim_type") == "confirmed_fact", _c("source_type").isin("community", "social")
    finance = _c("mode") == "finance"
    rules = [
        (F.coalesce(F.trim("claim_text"), F.lit("")) == "", "claim text is missing"),
        (~F.coalesce(_c("claim_type").isin(lx.CLAIM_TYPES), F.lit(False)), "unknown claim type"),
        (~F.coalesce(_c("verification_status").isin(lx.VERIFICATION_STATUSES), F.lit(False)), "unknown verification status"),
        (~F.coalesce(_c("output_level").isin(lx.OUTPUT_LEVELS), F.lit(False)), "unknown output level"),
        (~F.coalesce(_c("risk_tier").isin(lx.RISK_TIERS), F.lit(False)), "unknown risk tier"),
        (fact & crowd, "community or social claim is a confirmed fact"),
        (fact & (has("unobservable_evidence") | F.coalesce(_c("verification_status") == "unobservable", F.lit(False))), "confirmed fact is unobservable"),
        (fact & has("unsupported_causality"), "confirmed fact is causal"),
        (fact & finance & has("official_data_causality_mismatch"), "confirmed fact mismatches official data"),
        (finance & has(*lx.CRITICAL_FLAGS) & ~_c("output_level").isin("excluded", "review_only"), "critical finance claim is not excluded"),
        (crowd & _c("output_level").isin(FACT_LEVELS), "repetition by an untrusted source is in a fact bucket"),
    ]
    broken = F.array_compact(F.array(*[F.when(cond, F.lit(name)) for cond, name in rules]))
    return claims.select(entity, F.explode(broken).alias("rule"))


def source_violations(sources: DataFrame) -> DataFrame:
    """entity, id, rule: what is wrong with the records of sources (source_id, source_type, source_name, mode, captured_at)."""
    blank = lambda k: F.trim(F.coalesce(k, F.lit(""))) == ""
    named = ~blank("source_id")
    rules = [
        (blank("source_id"), "source_id is missing"),
        (named & ~F.coalesce(_c("source_type").isin(lx.SOURCE_TYPES), F.lit(False)), "unknown source type"),
        (named & blank("source_name"), "source_name is missing"),
        (named & blank("captured_at"), "captured_at is missing"),
        (~F.coalesce(_c("mode").isin("general", "finance"), F.lit(False)), "unknown mode"),
    ]
    found = F.array_compact(F.array(*[F.when(cond, F.lit(name)) for cond, name in rules]))
    run = F.coalesce("run_id", F.lit("")) if "run_id" in sources.columns else F.lit("")
    return sources.select(F.lit("source").alias("entity"), F.concat_ws("/", F.nullif(run, F.lit("")), F.coalesce("source_id", F.lit("<missing>"))).alias("id"), F.explode(found).alias("rule"))


def missing_sources(claims: DataFrame, sources: DataFrame) -> DataFrame:
    """Claims whose run has no record of their source.  Keys are counted first; what lacks a source is then found by key,
    so that a source of very many claims is no hot key.  A null key has no source."""
    keys = ["run_id", "source_id"]
    held = claims.groupBy(*keys).agg(F.count("*").alias("__n"))
    known = sources.filter("source_id is not null").select(*keys).distinct()
    return join_groups(claims, held.join(known, keys, "left_anti"), keys, "__n", "inner").drop("__n")


def confusion(rows: DataFrame, by: str) -> DataFrame:
    """rows (detector, expected, predicted, by): counts and precision, recall, F1, overall (null) and by group."""
    e, p = _c("expected"), _c("predicted")
    counts = rows.cube("detector", by).agg(
        F.count_if(e & p).alias("tp"), F.count_if(~e & p).alias("fp"), F.count_if(e & ~p).alias("fn"), F.count_if(~e & ~p).alias("tn")
    )
    counts = counts.filter("detector is not null")
    precision = F.try_divide(_c("tp"), _c("tp") + _c("fp"))
    recall = F.try_divide(_c("tp"), _c("tp") + _c("fn"))
    out = counts.withColumns({"precision": precision, "recall": recall})
    return out.withColumn("f1", F.try_divide(2 * _c("precision") * _c("recall"), _c("precision") + _c("recall")))


