"""PII spans by weak supervision: labelers vote, EM weighs them, a classifier decides.

Candidates are the base spans (e-mail, IP, card, phone by fixed patterns, always kept) and
wider ones: written-out or bracketed addresses, IPv6 and defanged IPs, digit groups of card
length that fail the base test, phone numbers without ``+``.  Four labelers vote +1, 0 or -1
on each: *format* and *boundary* (regex), *gazetteer* (known endings, prefixes, reserved
ranges) and *context* (words before the span).  All candidates of the corpus are summed to
vote-and-feature patterns, whose number is bounded by construction; expectation-maximisation
over the patterns estimates each labeler's reliabilities per kind, and a logistic span
classifier is trained on the patterns with the posteriors as soft labels.  A second narrow
pass adds the wider spans that the classifier accepts.

Everything that touches rows is DataFrame functions: no Python on executors, and the only
shuffle is the pattern count.

Defined cases: null is the empty text, which has no spans.  A kind without candidates gets
the labelers' majority as its classifier.  Ties, repeated rows and any text length are
handled row by row; extra columns are carried or ignored.
"""

from __future__ import annotations

from math import exp, log

from pyspark.sql import Column, DataFrame, functions as F

from .exprs import let

KINDS = ("email", "ip", "card", "phone")
#: Fixed base patterns: the look-behinds and possessive loops only save steps.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
OCTETS = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?:\.|$)){4}$"
#: Wider patterns.
EMAIL_WORDS = (r"(?i)(?<![a-z0-9._%+@-])[a-z0-9._%+-]++\x20?(?:\(at\)|\[at\]|\{at\})\x20?[a-z0-9-]++"
               r"(?:\x20?(?:\(dot\)|\[dot\]|\{dot\}|\.)\x20?[a-z0-9-]++)++(?![a-z0-9._%+@-])")
IP_WIDE = (r"(?<![0-9A-Fa-f:.])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:.])"
           r"|(?<![0-9.\]])[0-9]{1,3}(?:\[\.\][0-9]{1,3}){3}(?![0-9.\[])")
PHONE_WIDE = (r"(?<!\+[\x20().0-9-]{0,24})(?<![A-Za-z0-9])(?:00[1-9][0-9]{0,2}[\x20.-])?"
              r"(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z])")
#: Gazetteers and context words.
ENDINGS = "com|org|net|edu|gov|io|info|biz|de|fr|es|it|nl|uk|eu|ch|at|be|pl|pt|us|ca|jp|cn|in|br|mx|ru|se|no|dk|fi"
CARD_PREFIX = r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65|35|30|36|38|62)"
PHONE_PREFIX = r"^(?:00)?(?:1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
RESERVED = r"^(?:0|127|255|22[4-9]|23[0-9])\."
NEAR = {
    "email": r"(?i)mail|contact|write to|reach|schreib|correo|courriel",
    "ip": r"(?i)\bip\b|host|server|address|addr|login|client|from",
    "card": r"(?i)card|visa|master|amex|credit|debit|karte|tarjeta|carte|payment",
    "phone": r"(?i)phone|tel|call|fax|mobile|cell|whatsapp|anruf|llame|appel",
}
AGAINST = r"(?i)version|isbn|issn|doi|order|invoice|serial|sku|\bref\b|section|ticket|build|page"
#: Characters of context; accepted probability; rounds of EM and of the classifier's fit.
CONTEXT, ACCEPT, EM_ROUNDS, FIT_ROUNDS = 32, 0.5, 200, 200
VOTERS = ("format", "boundary", "gazetteer", "context")


def find(text: Column, pattern: str, here: Column) -> Column:
    """All matches (s, e, m) in code points where ``here`` holds, by what lies between them."""
    def add(acc: Column, z: Column) -> Column:
        s = acc["at"] + F.length(z["p"])
        return F.when(z["m"].isNull(), acc).otherwise(F.struct(
            (s + F.length(z["m"])).alias("at"),
            F.concat(acc["out"], F.array(F.struct(s.alias("s"), (s + F.length(z["m"])).alias("e"), z["m"].alias("m")))).alias("out")))

    none = F.array().cast("array<struct<s:int,e:int,m:string>>")
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("p"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"))
    return F.when(here, F.aggregate(parts, F.struct(F.lit(0).alias("at"), none.alias("out")), add)["out"]).otherwise(none)


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a digit string has a valid check digit."""
    def weigh(ch: Column, i: Column) -> Column:
        d = ch.cast("int")
        return F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.transform(F.split(F.reverse(number), "", -1), weigh), F.lit(0), lambda a, b: a + F.coalesce(b, F.lit(0))) % 10 == 0


def candidates(text: Column) -> Column:
    """All candidate spans: array of (kind, s, e, m, base, before, after), by kind, base ones first."""
    def row(kind: str, hits: Column, base: Column) -> Column:
        return F.transform(hits, lambda h: F.struct(
            F.lit(KINDS.index(kind)).alias("kind"), h["s"].alias("s"), h["e"].alias("e"), h["m"].alias("m"), base.alias("base")))

    def split(kind: str, hits: Column, good, wider=None) -> Column:
        """Base hits that pass ``good``, and the failing ones that are candidates by ``wider``."""
        kept = row(kind, F.filter(hits, lambda h: good(h["m"])), F.lit(True))
        if wider is None:
            return kept
        return F.concat(kept, row(kind, F.filter(hits, lambda h: ~good(h["m"]) & wider(h["m"])), F.lit(False)))

    every = lambda m: F.lit(True)
    count = lambda m: F.length(digits(m))

    def of(x: Column) -> Column:
        email = find(x, EMAIL, x.contains("@"))
        ip = find(x, IP, x.rlike(r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]"))
        card = F.filter(find(x, CARD, x.rlike(r"[0-9](?:[\x20-]?[0-9]){12}")), lambda h: F.length(h["m"]) >= 13)
        phone = find(x, PHONE, x.contains("+"))
        good_phone = lambda m: count(m).between(8, 15)
        phones = F.filter(phone, lambda h: good_phone(h["m"]))
        wide = let(F.struct(phones.alias("own"), find(x, PHONE_WIDE, x.rlike(r"[0-9][\x20.-][0-9]{4}(?![0-9])")).alias("more")),
                   lambda p: F.filter(p["more"], lambda h: ~F.exists(p["own"], lambda o: (o["s"] < h["e"]) & (h["s"] < o["e"]))))
        found = F.concat(
            row("email", email, F.lit(True)),
            row("email", find(x, EMAIL_WORDS, x.rlike(r"(?i)[(\[{]at[)\]}]")), F.lit(False)),
            let(ip, lambda h: split("ip", h, lambda m: m.rlike(OCTETS))),
            row("ip", find(x, IP_WIDE, x.contains("[.]") | x.rlike(r"(?:[0-9A-Fa-f]{1,4}:){7}")), F.lit(False)),
            let(card, lambda h: split("card", h, lambda m: count(m).between(16, 19) & luhn(digits(m)), lambda m: count(m).between(13, 19))),
            row("phone", phones, F.lit(True)),
            row("phone", wide, F.lit(False)))
        return F.transform(found, lambda c: F.struct(
            c["kind"], c["s"], c["e"], c["m"], c["base"],
            F.substring(x, F.greatest(c["s"] - CONTEXT, F.lit(0)) + 1, F.least(c["s"], F.lit(CONTEXT))).alias("before"),
            F.substring(x, c["e"] + 1, F.lit(1)).alias("after")))

    return let(F.coalesce(text, F.lit("")), of)


def features(c: Column) -> Column:
    """Votes (-1, 0, +1 of VOTERS) and 0/1 features of one candidate, as one array of int."""
    vote = lambda yes, no: F.when(yes, 1).when(no, -1).otherwise(0)
    kind = lambda k: c["kind"] == KINDS.index(k)
    by = lambda e, i, d, p: F.when(kind("email"), e).when(kind("ip"), i).when(kind("card"), d).otherwise(p)
    m, n = c["m"], digits(c["m"])
    never = F.lit(False)
    good = by(m.rlike(r"(?i)\.\x20?[a-z]{2,24}$|dot[)\]}]\x20?[a-z]{2,24}$"), m.rlike(OCTETS) | m.contains(":") | m.contains("["), luhn(n), F.length(n).between(10, 15))
    bad = by(m.rlike(r"\.\x20?[0-9]+$"), never, ~luhn(n), F.length(n) < 8)
    known = by(m.rlike(rf"(?i)(?:{ENDINGS})$"), ~m.rlike(RESERVED), n.rlike(CARD_PREFIX), n.rlike(PHONE_PREFIX))
    unknown = by(never, m.rlike(RESERVED), ~n.rlike(CARD_PREFIX), never)
    near = by(*(c["before"].rlike(NEAR[k]) for k in KINDS))
    glued = c["before"].rlike(r"[A-Za-z0-9_/.]$") | c["after"].rlike(r"[A-Za-z0-9_/]")
    votes = [vote(good, bad), vote(never, glued), vote(known, unknown), vote(near, c["before"].rlike(AGAINST))]
    flags = [c["base"], m.rlike(r"[\x20.()-]"), F.length(n) >= 16, c["before"].rlike(r"[:=]\x20?$")]
    return F.array(*votes, *(f.cast("int") for f in flags))


def patterns(docs: DataFrame, text: str = "text") -> DataFrame:
    """(kind, f, n): how many candidates of all texts show each vote-and-feature pattern."""
    spans = docs.select(F.explode(candidates(F.col(text))).alias("c"))
    return spans.select(F.col("c.kind").alias("kind"), features(F.col("c")).alias("f")).groupBy("kind", "f").agg(F.count(F.lit(1)).alias("n"))


def reliabilities(rows: list[tuple[list[int], int]]) -> tuple[list[float], list[list[dict[int, float]]]]:
    """EM over vote patterns: P(real) of each, and table[y][voter][vote] = P(vote | y)."""
    voters = range(len(VOTERS))
    post = [1 / (1 + exp(-1.5 * sum(v[j] for j in voters))) for v, _ in rows]
    table: list[list[dict[int, float]]] = []
    for _ in range(EM_ROUNDS):
        table = []
        for y in (0, 1):
            mass = [(p if y else 1 - p) * n for p, (_, n) in zip(post, rows)]
            side = []
            for j in voters:  # smoothing leans towards a voter that is right
                part = {v: (3.0 if v == (1 if y else -1) else 1.0) for v in (-1, 0, 1)}
                for w, (votes, _) in zip(mass, rows):
                    part[votes[j]] += w
                total = sum(part.values())
                side.append({v: x / total for v, x in part.items()})
            table.append(side)
        total = sum(n for _, n in rows)
        prior = (sum(p * n for p, (_, n) in zip(post, rows)) + 1) / (total + 2)
        odds = [log(prior / (1 - prior)) + sum(log(table[1][j][v[j]] / table[0][j][v[j]]) for j in voters) for v, _ in rows]
        post = [1 / (1 + exp(-max(-30.0, min(30.0, x)))) for x in odds]
    return post, table


def inputs(f: list[int]) -> list[float]:
    """Classifier inputs of a pattern: constant, each vote's two sides, flags."""
    votes = f[: len(VOTERS)]
    return [1.0, *(float(v > 0) for v in votes), *(float(v < 0) for v in votes), *(float(x) for x in f[len(VOTERS):])]


def fit(docs: DataFrame, text: str = "text") -> list[list[float]]:
    """Classifier weights of each kind, from the bounded pattern counts of the whole corpus."""
    counted: list[list[tuple[list[int], int]]] = [[] for _ in KINDS]
    for r in patterns(docs, text).orderBy("kind", "f").collect():
        counted[r["kind"]].append((list(r["f"]), r["n"]))
    out = []
    for rows in counted:
        n = len(VOTERS)
        if not rows:
            out.append([0.0] + [1.0] * n + [-1.0] * n + [0.0] * 4)
            continue
        post, _ = reliabilities(rows)
        xs, total = [inputs(f) for f, _ in rows], sum(c for _, c in rows)
        w = [0.0] * len(xs[0])
        for _ in range(FIT_ROUNDS):
            grad = [1e-3 * v for v in w]
            for x, p, (_, c) in zip(xs, post, rows):
                miss = (1 / (1 + exp(-max(-30.0, min(30.0, sum(a * b for a, b in zip(w, x)))))) - p) * c / total
                for k, v in enumerate(x):
                    grad[k] += miss * v
            w = [a - 2.0 * g for a, g in zip(w, grad)]
        out.append([round(v, 6) for v in w])
    return out


def probability(c: Column, weights: list[list[float]]) -> Column:
    """The classifier's probability that a candidate is personal data."""
    n = len(VOTERS)

    def score(f: Column) -> Column:
        given = [F.lit(1.0), *((f[j] > 0).cast("double") for j in range(n)), *((f[j] < 0).cast("double") for j in range(n)),
                 *(f[j].cast("double") for j in range(n, n + 4))]
        total = F.lit(0.0)
        for k, x in enumerate(given):
            w = F.lit(weights[-1][k])
            for kind in range(len(KINDS) - 1):
                w = F.when(c["kind"] == kind, F.lit(weights[kind][k])).otherwise(w)
            total = total + w * x
        return 1 / (1 + F.exp(-total))

    return let(features(c), score)


def spans_of(text: Column, weights: list[list[float]]) -> Column:
    """Accepted spans (kind, s, e, base) of a text, by kind then start."""
    keep = lambda c: c["base"] | (probability(c, weights) >= ACCEPT)
    return F.sort_array(F.transform(F.filter(candidates(text), keep), lambda c: F.struct(c["kind"], c["s"], c["e"], c["base"])))


def detect(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` as struct ``doc`` plus its accepted ``spans``.  Runs the fitting job when called."""
    weights = fit(docs, text)
    return docs.select(F.struct("*").alias("doc"), spans_of(F.col(text), weights).alias("spans"))


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    name = lambda k: F.element_at(F.array(*map(F.lit, KINDS)), k + 1)
    return F.array_join(F.transform(spans, lambda c: F.concat_ws(":", name(c["kind"]), c["s"].cast("string"), c["e"].cast("string"))), ",")


def redact(text: Column, spans: Column) -> Column:
    """The text with each span (of overlapping ones the first) replaced by its kind in angle brackets."""
    tag = lambda k: F.element_at(F.array(*(F.lit(f"<{k.upper()}>") for k in KINDS)), k + 1)

    def cut(x: Column) -> Column:
        def add(acc: Column, c: Column) -> Column:
            return F.struct(
                F.greatest(acc["at"], c["e"]).alias("at"),
                F.when(c["s"] < acc["at"], acc["out"]).otherwise(F.concat(acc["out"], F.array(
                    F.substring(x["t"], acc["at"] + 1, c["s"] - acc["at"]), tag(c["kind"])))).alias("out"))

        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
        ordered = F.sort_array(F.transform(x["p"], lambda c: F.struct(c["s"].alias("s"), c["e"].alias("e"), c["kind"].alias("kind"))))
        return let(F.aggregate(ordered, start, add), lambda a: F.concat(
            F.array_join(a["out"], ""), F.substring(x["t"], a["at"] + 1, F.length(x["t"]))))

    return F.when(F.size(spans) > 0, let(F.struct(text.alias("t"), spans.alias("p")), cut)).otherwise(text)


def mask(docs: DataFrame, text: str = "text", length: str = "n_chars") -> DataFrame:
    """``docs`` with spans replaced by their kinds; ``length``, where there is one, follows the text."""
    found = detect(docs, text).withColumn("new", redact(F.col("doc")[text], F.col("spans")))
    change = {text: F.col("new"), length: F.length("new").cast("bigint")}
    return found.select(*[change[c].alias(c) if c in change else F.col("doc")[c].alias(c) for c in docs.columns])
