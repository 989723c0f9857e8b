"""Personal data: rule-based spans, and more spans by weak supervision. DataFrame functions only.

Base spans are the matches of four fixed patterns that pass their checks. The
patterns below are written so that a text of any length is matched in linear
time: a run of characters is tried once, from its start or from where the last
match ended, and possessive quantifiers never give back what they took; the
matches are those of the plain patterns.

Looser patterns propose more: disguised addresses, national telephone numbers,
card numbers of other lengths or inside longer runs of digits, and secrets given
to a name. For every candidate five labelers vote +1, 0 or -1: its shape
(pattern and length, which go together, vote once), a check (Luhn, numbering
plan, mixture of characters), a list (issuers, top-level domains, names of
secrets), the context (words before it that speak for or against) and its edges
(units, currencies, dates, placeholders). For each kind of its own, votes are
counted by pattern (at most 3 to the number of labelers), and
expectation-maximisation on these counts estimates the labelers' reliabilities
and the posterior of each pattern. The posteriors then train the final span
classifier, which does not see the votes: a naive Bayes model over hashed
features of the span (shape, digits, separators, neighbouring characters and
words), whose sums per bucket are one aggregation and whose weights are a list
of fixed size. Candidates are added under the kinds ``*_like`` if the
classifier gives ``accept`` or more, the check is not against them, and they
overlap no base span.

Defined cases: null texts count as empty and have no spans; very long texts are
matched whole; rows with repeated or null identifiers, and rows that repeat, are
judged row by row; of candidates that overlap one another all are given, longer
first; an empty table gives an empty result; offsets count code points, ends are
exclusive; other columns, whatever their names, are ignored (``redact`` keeps
them).
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keyfold.llm.shared import saved, table, whole_text

KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "email_like": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?[\[(]\x20?(?:at|AT|@)\x20?[\])]\x20?[A-Za-z0-9-]{1,63}+(?:(?:\.|\x20?[\[(]\x20?(?:dot|DOT)\x20?[\])]\x20?)[A-Za-z0-9-]{1,63}+){0,8}+",
    "phone_like": r"(?<![0-9A-Za-z+.,/-])(?:\([0-9]{2,5}\)\x20?|[0-9]{2,5}[\x20./-])[0-9]{2,5}(?:[\x20.-][0-9]{2,5}){0,4}+(?![0-9A-Za-z]|[.,/-][0-9])",
    "card_like": r"(?<![0-9A-Za-z.+-])(?:[0-9]{13,19}+|[0-9]{4}(?:[\x20-][0-9]{4}){3}|[0-9]{4}[\x20-][0-9]{6}[\x20-][0-9]{5})(?![0-9A-Za-z-])",
    "secret_like": r"(?i)(?<![a-z0-9])(?:[a-z0-9]{1,20}[_-]){0,3}(?:token|secret|password|passwd|pwd|apikey|api[_-]key|access[_-]key|private[_-]key|auth[_-]key|credential)\x20{0,3}(?:=|:=|:)\x20{0,3}[\"']?[A-Za-z0-9+/_.=!@#$%^&*~-]{6,256}+[\"']?",
}
NEEDS = {"email": "@", "phone": "+", "ip": ".", "email_like": r"[\[(]", "secret_like": "[=:]"}  # a text without this has no match
LABELERS = ("shape", "check", "list", "context", "edge")
# gazetteers: fixed values
FOR = {
    "email_like": "email e-mail mail emails contact write reach address mailto inbox correo courriel adresse kontakt schreiben message send".split(),
    "phone_like": "phone phones tel telephone telefon telefono telephones call calls called calling mobile cell cellphone fax whatsapp sms text dial ring hotline number handy movil portable appelez llame anrufen contact reach ext landline pager signal viber".split(),
    "card_like": "card cards visa mastercard amex maestro discover diners credit debit creditcard carte karte tarjeta payment pay paid charge charged cc pan account expiry cvv cvc".split(),
    "secret_like": "export set env config bearer auth login user username header credentials key token secret password".split(),
}
AGAINST = {
    "email_like": "look looked looking arrived meet met stay stayed example see".split(),
    "phone_like": "page pages order orders invoice version isbn issn item items total price year years date dated chapter section figure table score scores won lost between from since until room vol volume no nr ref part batch lot sku model serial error line lines range ratio sum".split(),
    "card_like": "order invoice tracking isbn item serial barcode ean upc id timestamp hash reference batch lot sku parcel".split(),
    "secret_like": "example sample placeholder dummy fake".split(),
}
DOMAINS = "com org net edu gov mil int info biz name io co ai app dev me tv us uk de fr es it nl be ch at pl cz se no fi dk pt ie ru ua cn jp kr in br mx ca au nz za ar cl eu tr gr hu ro".split()
ISSUERS = r"^(?:4(?:[0-9]{12}|[0-9]{15}|[0-9]{18})|5[1-5][0-9]{14}|2[2-7][0-9]{14}|3[47][0-9]{13}|6(?:011|5[0-9]{2}|4[4-9][0-9])[0-9]{12,15}|3(?:0[0-5]|[68][0-9])[0-9]{11}|35[0-9]{14}|62[0-9]{14,17}|(?:50|5[6-9]|6[0-9])[0-9]{10,17})$"
SECRETS = r"(?i)(?:token|secret|password|passwd|api[_-]?key|access[_-]key|private[_-]key)"
LIKE = tuple(k for k in PATTERNS if k.endswith("_like"))
BUCKETS = 1 << 10  # for each kind


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    back = F.reverse(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(back, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return total + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(digits), F.lit(1))), F.lit(0), add) % 10 == 0


def _octets(hit: Column) -> Column:
    return F.forall(F.split(hit, r"\."), lambda p: (F.length(F.regexp_replace(p, "^0+", "")) < 4) & (F.coalesce(F.substring(F.regexp_replace(p, "^0+(?=.)", ""), 1, 3).cast("int"), F.lit(0)) <= 255))


def _votes(kind: Column, hit: Column, digits: Column, luhn: Column, before: Column, after: Column) -> dict[str, Column]:
    """Each labeler's vote; 0 where it has nothing to say."""
    n = F.length(digits)
    said = F.array_except(F.split(F.regexp_replace(before, "[^\\p{L}-]+$", ""), "[^\\p{L}-]+"), F.array(F.lit("")))
    any_of = lambda words: F.arrays_overlap(said, F.array(*[F.lit(w) for w in words]))
    value = F.regexp_replace(hit, "(?s)^[^=:]*[=:]=?\\x20*[\"']?|[\"']$", "")

    def by_kind(plus: dict[str, Column], minus: dict[str, Column]) -> Column:
        out = F
        for k in LIKE:
            p, m = (F.coalesce(x[k], F.lit(False)) if k in x else F.lit(False) for x in (plus, minus))
            out = out.when(kind == k, F.when(p, 1).when(m, -1).otherwise(0))
        return out.otherwise(0)

    national = r"^\(?[0-9]{3}\)?[\x20.-]?[0-9]{3}[\x20.-][0-9]{4}$|^0[0-9](?:[\x20.-][0-9]{2}){4}$|^\(?0[0-9]{2,4}\)?[\x20/-][0-9]{3,5}(?:[\x20-][0-9]{2,5}){0,2}$"
    dates = r"^[0-9]{4}[./-][0-9]{2}[./-][0-9]{2}$|^[0-9]{2}[./-][0-9]{2}[./-][0-9]{2,4}$|^(?:19|20)[0-9]{2}[\x20/-](?:19|20)?[0-9]{2}$"
    return {
        "shape": by_kind(
            {"email_like": hit.rlike(r"(?i)[\[(]\x20?dot\x20?[\])]|\.[a-z]{2,}$"), "phone_like": hit.rlike(national), "card_like": hit.rlike("[\\x20-]") | n.isin(15, 16), "secret_like": F.length(value).between(16, 128)},
            {"email_like": ~hit.rlike(r"(?i)[\[(]\x20?dot\x20?[\])]|\."), "phone_like": ~n.between(7, 13) | hit.rlike(dates), "card_like": F.lit(False), "secret_like": F.length(value) < 10},
        ),
        "check": by_kind(
            {"email_like": hit.rlike(r"^[^\[(]*[A-Za-z]"), "phone_like": digits.rlike("^[2-9][0-9]{2}[2-9][0-9]{6}$|^0[1-9][0-9]{6,11}$"), "card_like": luhn, "secret_like": value.rlike("[0-9]") & value.rlike("[A-Za-z]")},
            {"email_like": hit.rlike(r"^[0-9._%+-]+\x20?[\[(]"), "phone_like": digits.rlike(r"^(.)\1*$") | hit.rlike(dates), "card_like": ~luhn, "secret_like": value.rlike(r"(?i)^(?:[a-z]+|[0-9]+|(.)\1+)$")},
        ),
        "list": by_kind(
            {"email_like": F.lower(F.regexp_extract(hit, r"([A-Za-z]+)$", 1)).isin(DOMAINS), "phone_like": digits.rlike("^(?:0|[2-9][0-9]{2}[2-9])"), "card_like": digits.rlike(ISSUERS), "secret_like": hit.rlike("^" + SECRETS + r"|[_-]" + SECRETS)},
            {"email_like": ~F.lower(F.regexp_extract(hit, r"([A-Za-z]+)$", 1)).isin(DOMAINS), "card_like": ~digits.rlike(ISSUERS), "secret_like": F.lower(value).isin("changeme", "password", "example", "placeholder", "undefined", "required", "optional", "string")},
        ),
        "context": by_kind({k: any_of(FOR[k]) & ~any_of(AGAINST[k]) for k in LIKE}, {k: any_of(AGAINST[k]) & ~any_of(FOR[k]) for k in LIKE}),
        "edge": by_kind(
            {"secret_like": hit.rlike("[\"']$"), "card_like": after.rlike(r"^[\x20,;]{0,2}(?:exp|cvv|cvc)"), "phone_like": after.rlike(r"^\x20?(?:ext|x[0-9])")},
            {k: after.rlike(r"^\x20?(?:%|kg|km|cm|mm|eur|usd|gbp|\$|€|£|x\b)") | before.rlike(r"[#$€£§]\x20?$") for k in ("phone_like", "card_like")} | {"secret_like": F.lower(value).rlike(r"your|example|xxx|\*\*\*|<|\$\{")},
        ),
    }


def _features(kind: Column, hit: Column, digits: Column, before: Column, after: Column) -> Column:
    """Buckets of a span's own features: ``BUCKETS`` for each kind of its own."""
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace(hit, "[0-9]", "9"), "[A-Z]", "A"), "[a-z]", "a")
    words = F.array_except(F.split(F.regexp_replace(before, "[^\\p{L}-]+$", ""), "[^\\p{L}-]+"), F.array(F.lit("")))
    groups = F.regexp_replace(shape, "(.)\\1*", "$1")
    text = F.concat(
        F.array(
            F.concat(F.lit("shape "), F.substring(shape, 1, 40)),
            F.concat(F.lit("groups "), F.substring(groups, 1, 24)),
            F.concat(F.lit("digits "), F.length(digits).cast("string")),
            F.concat(F.lit("length "), F.floor(F.log2(F.length(hit)) * 2).cast("string")),
            F.concat(F.lit("first "), F.substring(digits, 1, 2)),
            F.concat(F.lit("last "), F.lower(F.regexp_extract(hit, "([A-Za-z]*)[\"']?$", 1))),
            F.concat(F.lit("left "), F.right(before, F.lit(1))),
            F.concat(F.lit("right "), F.substring(after, 1, 1)),
        ),
        F.transform(F.slice(F.reverse(words), 1, 3), lambda w: F.concat(F.lit("word "), w)),
    )
    number = F
    for i, k in enumerate(LIKE):
        number = number.when(kind == k, i)
    return F.when(kind.isin(*LIKE), F.transform(text, lambda t: (number * BUCKETS + F.pmod(F.xxhash64(t), F.lit(BUCKETS))).cast("int")))


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """One row per match of any pattern (and one without a kind for a row that has none), with its votes and features.

    ``row_col``: a stored column that numbers the rows; without one they are numbered here, and only spans can be told by ``_row``.
    """
    text = F.col("_t")
    rows = docs.select(F.col(id_col), (F.col(row_col) if row_col else F.monotonically_increasing_id()).alias("_row"), whole_text(text_col).alias("_t"))
    none = F.expr("CAST(array() AS array<string>)")

    def only(kind: str, c: Column) -> Column:
        if kind not in NEEDS:
            return c
        need = NEEDS[kind]
        return F.when(F.contains(text, F.lit(need)) if len(need) == 1 else text.rlike(need), c).otherwise(none)

    rows = rows.select(
        id_col,
        "_row",
        *[only(k, F.regexp_extract_all(text, F.lit(p), F.lit(0))).alias(f"h_{k}") for k, p in PATTERNS.items()],
        *[only(k, F.split(text, p, -1)).alias(f"p_{k}") for k, p in PATTERNS.items()],
    )

    def structs(k: str) -> Column:
        hit, gaps, n = F.col(f"h_{k}").alias("h"), f"p_{k}", F.size(f"h_{k}")
        both = F.arrays_zip(hit, F.slice(gaps, F.lit(1), n).alias("p"), F.slice(gaps, F.lit(2), n).alias("q"))
        return F.transform(
            both,
            lambda x: F.struct(
                F.lit(k).alias("kind"),
                F.char_length(x["h"]).alias("length"),
                F.char_length(x["p"]).alias("gap"),
                x["h"].alias("hit"),
                F.lower(F.right(x["p"], F.lit(32))).alias("before"),
                F.lower(F.substring(x["q"], 1, 8)).alias("after"),
            ),
        )

    hits = rows.select(id_col, "_row", F.posexplode_outer(F.concat(*[structs(k) for k in PATTERNS])).alias("_pos", "_hit")).select(id_col, "_row", "_pos", "_hit.*")
    order = W.partitionBy("_row", "kind").orderBy("_pos")
    hits = hits.withColumn("start", F.sum("gap").over(order) + F.coalesce(F.sum("length").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    kind, hit, digits, n = F.col("kind"), F.col("hit"), F.col("digits"), F.length("digits")
    hits = hits.withColumn("digits", _digits(hit)).withColumn("luhn", F.when(kind.isin("card", "card_like") & n.between(13, 19), _luhn(digits)).otherwise(False))
    ok = F.when(kind == "email", True).when(kind == "ip", _octets(hit)).when(kind == "card", n.between(16, 19) & F.col("luhn")).when(kind == "phone", n.between(8, 15)).otherwise(False)
    around = (F.col("before"), F.col("after"))
    votes = _votes(kind, hit, digits, F.col("luhn"), *around)
    return hits.select(id_col, "_row", "kind", "start", (F.col("start") + F.col("length")).alias("end"), (ok & kind.isNotNull()).alias("ok"), *[v.alias(k) for k, v in votes.items()], _features(kind, hit, digits, *around).alias("features"))


def em(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 60, prior: float = 0.5, anchor: float = 20.0) -> dict[tuple[int, ...], float]:
    """Posterior of each vote pattern; a labeler has a share of +1, 0 and -1 in either class, which starts at and is held by ``anchor`` votes as guessed."""
    n = len(LABELERS)
    guess = {1: {1: 0.5, 0: 0.4, -1: 0.1}, 0: {1: 0.15, 0: 0.45, -1: 0.4}}
    chance = {c: [dict(guess[c]) for _ in range(n)] for c in (0, 1)}
    posterior: dict[tuple[int, ...], float] = {}
    for _ in range(rounds):
        for votes, _n in patterns:
            odds = math.log(prior / (1 - prior)) + sum(math.log(chance[1][i][v] / chance[0][i][v]) for i, v in enumerate(votes))
            posterior[votes] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
        total = sum(c for _, c in patterns)
        prior = (sum(c * posterior[v] for v, c in patterns) + 1) / (total + 2)
        for c in (0, 1):
            share = lambda v, c=c: posterior[v] if c else 1 - posterior[v]
            mass = sum(k * share(v) for v, k in patterns) + anchor
            chance[c] = [{s: (sum(k * share(v) for v, k in patterns if v[i] == s) + anchor * guess[c][s]) / mass for s in (1, 0, -1)} for i in range(n)]
    return posterior


def _literal(values: list[float]) -> Column:
    return F.from_json(F.lit(json.dumps(values)), "array<double>")


def with_probability(hits: DataFrame) -> DataFrame:
    """``hits`` with the final classifier's probability for the looser kinds: posteriors by kind, then naive Bayes on features.

    The driver holds one row for each vote pattern and one for each bucket, whatever the corpus.
    """
    n = len(LABELERS)
    counted = hits.filter(F.col("kind").isin(*LIKE)).groupBy("kind", *LABELERS).count().collect()  # at most 3 ** labelers for each kind
    by_pattern = [0.5] * (len(LIKE) * 3**n)
    for i, k in enumerate(LIKE):
        patterns = sorted((tuple(r[x] for x in LABELERS), r["count"]) for r in counted if r["kind"] == k)
        for votes, p in em(patterns).items() if patterns else ():
            by_pattern[i * 3**n + sum((v + 1) * 3**j for j, v in enumerate(votes))] = p
    number = F
    for i, k in enumerate(LIKE):
        number = number.when(F.col("kind") == k, i)
    place = number * 3**n + sum(((F.col(x) + 1) * 3**j for j, x in enumerate(LABELERS)), F.lit(0))
    soft = hits.withColumn("posterior", F.get(_literal(by_pattern), place.cast("int")))
    each = soft.filter("features IS NOT NULL").select(F.explode(F.array_distinct("features")).alias("f"), "posterior")
    sums = {r["f"]: (r["p"], r["n"]) for r in each.groupBy("f").agg(F.sum("posterior").alias("p"), F.count("*").alias("n")).collect()}  # at most BUCKETS for each kind
    weights, start = [0.0] * (len(LIKE) * BUCKETS), []
    for i, k in enumerate(LIKE):
        total = sum(r["count"] for r in counted if r["kind"] == k)
        good = sum(r["count"] * by_pattern[i * 3**n + sum((r[x] + 1) * 3**j for j, x in enumerate(LABELERS))] for r in counted if r["kind"] == k)
        share = (good + 0.05) / (total + 0.1)
        start.append(math.log(share / (1 - share)))
        for f in range(i * BUCKETS, (i + 1) * BUCKETS):
            if f in sums:
                p, m = sums[f]
                usual = 4 * m / total  # four spans as usual in either class
                weights[f] = math.log((p + usual) / (good + 4)) - math.log((max(m - p, 0.0) + usual) / (max(total - good, 0.0) + 4))
    z = F.get(_literal(start), number) + F.aggregate(F.array_distinct("features"), F.lit(0.0), lambda s, f: s + F.get(_literal(weights), f)) / 3
    return soft.withColumn("probability", F.when(F.col("ok"), F.lit(1.0)).when(F.col("features").isNotNull(), 1 / (1 + F.exp(-z))).otherwise(0.0))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", accept: float = 0.9, row_col: str | None = None) -> DataFrame:
    """All spans: id, _row, kind (null for a row without any), start, end, base, probability."""
    hits = with_probability(saved(candidates(docs, id_col, text_col, row_col), "pii"))
    base, loose = F.col("ok"), F.col("kind").isin(*LIKE)
    order = W.partitionBy("_row").orderBy("start", "end")
    before = F.max(F.when(base, F.col("end"))).over(order.rowsBetween(W.unboundedPreceding, -1))
    after = F.min(F.when(base, F.col("start"))).over(order.rowsBetween(1, W.unboundedFollowing))
    free = (F.coalesce(before, F.lit(-1)) <= F.col("start")) & (F.coalesce(after, F.col("end")) >= F.col("end"))
    hits = hits.withColumn("_free", free)
    keep = base | (loose & F.col("_free") & (F.col("check") >= 0) & (F.col("probability") >= accept))
    shown = lambda c: F.when(keep, F.col(c)).alias(c)
    return hits.select(id_col, "_row", shown("kind"), shown("start"), shown("end"), F.when(keep, base).alias("base"), shown("probability"))


def spans_by_row(spans: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per document row: its counts and its spans as sorted arrays of (order, start, end, kind)."""
    place = F.when(F.col("kind") == KINDS[0], 0)
    for i, k in enumerate(KINDS[1:], 1):
        place = place.when(F.col("kind") == k, i)
    one = F.struct(place.otherwise(len(KINDS)).alias("order"), "kind", "start", "end")
    return spans.groupBy("_row").agg(
        F.first(id_col).alias(id_col),
        *[F.count(F.when(F.col("base") & (F.col("kind") == k), 1)).alias(f"n_{k}") for k in KINDS],
        F.array_sort(F.collect_list(F.when(F.col("base"), one))).alias("base"),
        F.array_sort(F.collect_list(F.when(F.col("kind").isNotNull(), one))).alias("spans"),
    )


def _joined(spans: str) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; a null text stays null, all other columns stay as they are."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc")
    docs = saved(docs.select(F.monotonically_increasing_id().alias("_row"), whole), "pii_docs")  # stored: a later scan may be split otherwise
    spans = find(docs.select("_row", F.col("_doc")[id_col].alias("_id"), F.col("_doc")[text_col].alias("_t")), "_id", "_t", row_col="_row").filter("kind IS NOT NULL")
    order = W.partitionBy("_row").orderBy("start", F.desc("end"), "kind")
    spans = spans.withColumn("_from", F.coalesce(F.max("end").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    cut = F.struct("start", (-F.col("end")).alias("until"), "kind", "_from")
    by_row = spans.groupBy("_row").agg(F.array_sort(F.collect_list(cut)).alias("_cuts"), F.max("end").alias("_end"))
    out = docs.join(by_row, "_row", "left")
    text = F.col("_doc")[text_col]
    # a span that begins inside another one lengthens what is cut out
    parts = F.transform(
        "_cuts",
        lambda s: F.when(s["start"] >= s["_from"], F.concat(F.substring(text, (s["_from"] + 1).cast("int"), (s["start"] - s["_from"]).cast("int")), F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise(F.lit("")),
    )
    new = F.when(F.col("_cuts").isNull(), text).otherwise(F.concat(F.array_join(parts, ""), F.substring(text, (F.col("_end") + 1).cast("int"), F.char_length(text))))
    return out.select(F.col("_doc").withField(f"`{text_col}`", new).alias("_doc")).select("_doc.*")


def op4_weak_supervision_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = spans_by_row(find(table(spark, sf_dir, "documents")))
    return out.select("doc_id", *[f"n_{k}" for k in KINDS], F.sha2(_joined("base").cast("binary"), 256).alias("base_sha256"), _joined("spans").alias("spans"))
