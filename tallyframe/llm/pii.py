"""Personal data by aggregated weak supervision.

Base spans (email, ip, card, phone) are fixed patterns with checks and always stay. Candidates for
further spans come from looser patterns: written-out addresses, telephone numbers as several countries
write them, and long mixed strings that may be secrets. On every candidate and base span labelers vote
yes, no or abstain: the pattern's strict form; a gazetteer of known values (mail providers, issuer and
calling codes, number plans, prefixes of issued keys); words in front of the span that speak for its
kind; names of people and places in front of it; marks around it; the mix of its letters and digits;
words that speak against it. Expectation-maximisation over the counts of vote patterns estimates how
reliable each labeler is; its posteriors train a logistic classifier on the votes and the span's shape,
and candidates it accepts that do not overlap a base span are added.

All per-row work is Spark SQL. The driver sees only the counts of vote and shape patterns, whose number
is bounded by the labelers, whatever the table's size. Spans and their votes are found once and written to
the shared folder; the counts read only the votes. Positions are code points, ends exclusive.
Null and empty texts have no spans; repeated rows are read each on its own.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.store import documents, packed, stage, text_columns, unpacked

BASE = ("email", "ip", "card", "phone")
ADDED = ("address", "number", "secret")

# A pattern may begin at a run's first character or where the last match ended, which is where the
# leftmost match begins; possessive repeats can't backtrack, so no text is read more than once.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?=[0-9])(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
ADDRESS = (r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?(?:\(at\)|\[at\]| at ) ?[A-Za-z0-9-]{1,63}+"
           r" ?(?:\(dot\)|\[dot\]| dot ) ?[A-Za-z]{2,24}+(?![A-Za-z0-9])")
NUMBER_FORMS = (
    r"(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}",                     # area code, exchange, line
    r"0[1-9](?:[ .-][0-9]{2}){4}",                                               # pairs after a trunk zero
    r"(?:\(0[0-9]{2,4}\) ?|0[0-9]{2,4}[ /-])[0-9]{3,4}[ -]?[0-9]{3,5}",          # trunk zero and area code
    r"00[1-9][0-9]{0,2}(?:[ .-][0-9]{2,4}){2,4}",                                # 00 for the plus
)
NUMBER = r"(?<![0-9+.-])(?:" + "|".join(NUMBER_FORMS) + r")(?![0-9])"
SECRET = r"(?<![A-Za-z0-9])[A-Za-z0-9]{16,}+(?![A-Za-z0-9])"
PATTERNS = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE, "address": ADDRESS, "number": NUMBER, "secret": SECRET}

# Words in front of a span that speak for a kind, names, and words that speak against any.
CONTEXT_WORDS = {
    "email": "email e-mail mail contact write reply correo courriel", "address": "email e-mail mail contact write reply correo courriel",
    "ip": "ip address host server client", "phone": "phone tel call mobile fax contact telefon teléfono téléphone",
    "card": "card visa payment account pay karte tarjeta carte", "number": "phone tel call mobile fax contact telefon teléfono téléphone",
    "secret": "password passwd pwd token secret key apikey credential passwort contraseña",
}
PEOPLE = ("Alice Ana Anna Antonio Carlos Carmen Claire David Elena Emma Fatima Hans Ivan James Jane John José Juan Julia Karl Laura "
          "Lucas Luis Maria Marie Mark Martin Michael Mohammed Paul Peter Pierre Robert Sarah Sofia Thomas")
PLACES = ("Amsterdam Barcelona Berlin Boston Brussels Chicago Dallas Dublin Geneva Hamburg Lisbon London Lyon Madrid Manila Mexico "
          "Milan Munich Paris Rome Seattle Toronto Vienna Zurich")
# What spans of a kind are known to hold or begin with.
PROVIDERS = "gmail googlemail yahoo hotmail outlook live icloud gmx aol proton protonmail mail web example"
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65)"
CALLING = r"^(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|2[1-689][0-9]|35[0-9]|37[0-9]|38[0-9]|42[0-9]|50[0-9]|59[0-9]|67[0-9]|68[0-9]|85[0-9]|88[0-9]|96[0-9]|97[0-9]|99[0-9])"
KEYS = r"(?:^|[^A-Za-z0-9])(?:AKIA|ASIA|AIza|eyJ|(?:ghp|gho|ghs|glpat|hf|npm|sk|pk|rk|xoxb|xoxp)(?:[_-](?:live|test))?[_-])$"
KEY_START = r"^(?:AKIA|ASIA|AIza|eyJ)"
AGAINST = "version isbn doi sha commit build serial model figure page"
CONTEXT = 24
PORTION = 128
VOTES = ("strict", "gazetteer", "context", "names", "marks", "mix", "against")
ROUNDS = 60


def _digits(m):
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(m):
    """The checksum of card numbers over the digits of a match."""
    d = F.reverse(_digits(m))
    values = F.transform(F.split(d, "(?!^)(?!$)"), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(
        c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(values, F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: str, m):
    if kind == "ip":
        part = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
        return m.rlike(rf"^{part}\.{part}\.{part}\.{part}$")
    if kind == "card":
        n = F.length(_digits(m))
        return F.when(n.between(13, 19), _luhn(m)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(m)).between(9, 15)
    if kind == "secret":
        return m.rlike("[0-9]") & m.rlike("[A-Za-z]") | m.rlike(KEY_START)
    return F.lit(True)


def _spans(kind: str, text, guard):
    """Matches of a kind with their places: the text between matches gives the offsets."""
    none = F.array().cast("array<struct<kind:string,s:int,e:int,m:string>>")
    found = F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))
    gaps = F.split(text, PATTERNS[kind], -1)
    kept = lambda pos, out: F.struct(pos.alias("pos"), out.alias("out"))

    def step(acc, x):
        s = acc["pos"] + F.length(x["g"])
        e = s + F.length(x["m"])
        one = F.array(F.struct(F.lit(kind).alias("kind"), s.alias("s"), e.alias("e"), x["m"].alias("m")))
        return kept(e, F.concat(acc["out"], F.when(_valid(kind, x["m"]), one).otherwise(none)))
    zipped = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, m: F.struct(g.alias("g"), m.alias("m")))

    def portion(acc, k):
        # matches are walked through in portions, so that no long array is copied at every match
        inner = F.aggregate(F.slice(acc["all"], k * PORTION + 1, F.lit(PORTION)), kept(acc["pos"], none), step)
        return F.element_at(F.transform(F.array(inner), lambda i: F.struct(
            i["pos"].alias("pos"), F.concat(acc["out"], F.array(i["out"])).alias("out"), acc["all"].alias("all"))), 1)
    start = F.struct(F.lit(0).alias("pos"), F.array(none).alias("out"), zipped.alias("all"))
    walk = F.aggregate(F.sequence(F.lit(0), F.floor((F.size(found) - 1) / PORTION).cast("int")), start, portion,
                       lambda a: F.flatten(a["out"]))
    return F.when(guard & (F.size(found) > 0), walk).otherwise(none)


def _any(words: str) -> str:
    return r"(?<![\p{L}])(?:" + words.replace(" ", "|") + r")(?![\p{L}])"


def _votes(s, text):
    """Votes of the labelers on a span: 1 yes, -1 no, 0 none; and its shape."""
    kind, m = s["kind"], s["m"]
    front = F.substring(text, F.greatest(s["s"] - CONTEXT, F.lit(0)) + 1, s["s"] - F.greatest(s["s"] - CONTEXT, F.lit(0)))
    before, after = F.lower(front), F.substring(text, s["e"] + 1, F.lit(1))
    digits = _digits(m)
    yes = lambda condition, otherwise: F.when(condition, 1).otherwise(otherwise)
    strict = (F.when(kind == "secret", yes(m.rlike("^(?:[0-9a-f]{16,}|[0-9A-F]{16,})$"), 0))
              .when(kind == "address", yes(m.rlike(r"\(|\["), 0))
              .when(kind == "number", F.when(m.rlike(r"^\([0-9]{3}\) [0-9]{3}-[0-9]{4}$|^([0-9]{3})([ .-])[0-9]{3}\2[0-9]{4}$"
                                                     r"|^0[1-9]([ .-])[0-9]{2}(?:\3[0-9]{2}){3}$"), 1)
                    .otherwise(F.when(m.rlike("^" + NUMBER_FORMS[0] + "$"), -1).otherwise(0)))
              .otherwise(1))
    gazetteer = (F.when(kind.isin("email", "address"), yes(F.lower(m).rlike(_any(PROVIDERS)), 0))
                 .when(kind == "ip", F.when(m.rlike(r"^(?:0|127|255)\."), -1).otherwise(0))
                 .when(kind == "card", yes(digits.rlike(ISSUERS), -1))
                 .when(kind == "phone", yes(digits.rlike(CALLING), -1))
                 .when(kind == "number", yes(digits.rlike("^[2-9][0-9]{2}[2-9][0-9]{6}$"), F.when(digits.rlike("^00?[1-9]"), 0).otherwise(-1)))
                 .otherwise(yes(m.rlike(KEY_START) | front.rlike(KEYS), 0)))
    words = F.lit(False)
    for k, w in CONTEXT_WORDS.items():
        words = F.when(kind == k, before.rlike(_any(w))).otherwise(words)
    names = yes(kind.isin("email", "address", "phone", "number") & front.rlike(_any(f"{PEOPLE} {PLACES}")), 0)
    marks = (F.when(before.rlike("[=:] ?[\"']?$"), 1).when((before.rlike("[/_#]$") & ~front.rlike(KEYS)) | after.isin("/", "_", "#"), -1).otherwise(0))
    share = F.length(digits) / F.length(m)
    runs = F.size(F.regexp_extract_all(m, F.lit("[0-9]+"), F.lit(0)))
    few = F.size(F.array_distinct(F.split(digits, "(?!^)(?!$)"))) <= 2
    mix = (F.when(kind == "secret", F.when((runs >= 3) & m.rlike("[a-z]") & m.rlike("[A-Z]"), 1)
                  .when((runs >= 2) | m.rlike("^[A-Za-z]+[0-9]+[A-Za-z]+$"), 0).otherwise(-1))
           .when(kind.isin("address", "email"), F.when(share < 0.5, 0).otherwise(-1))
           .when(kind == "ip", F.lit(0)).otherwise(F.when(few, -1).otherwise(0)))
    against = F.when(before.rlike(_any(AGAINST)), -1).otherwise(0)
    return {"strict": strict, "gazetteer": gazetteer, "context": yes(words, 0), "names": names, "marks": marks, "mix": mix, "against": against,
            "size": F.least(F.floor(F.length(m) / 8), F.lit(5)).cast("int"), "digits": F.floor(share * 4).cast("int")}


def spans(docs: DataFrame, *keep: str) -> DataFrame:
    """The columns ``keep`` with ``text``, its base spans and its candidates for further ones."""
    t = F.coalesce(F.col("text").cast("string"), F.lit(""))
    d = docs.select(*keep, t.alias("text"))
    digit = F.col("text").rlike("[0-9]")
    guards = {"email": F.col("text").contains("@"), "ip": digit, "card": digit, "phone": digit & F.col("text").contains("+"),
              "address": F.col("text").rlike(r"[(\[ ]dot[)\] ]"), "number": digit, "secret": digit}
    d = d.withColumns({f"_{k}": _spans(k, F.col("text"), g) for k, g in guards.items()})
    d = d.withColumn("base", F.concat(*[f"_{k}" for k in BASE])).withColumn("more", F.concat(*[f"_{k}" for k in ADDED]))
    free = F.filter("more", lambda c: ~F.exists("base", lambda b: (b["s"] < c["e"]) & (c["s"] < b["e"])))
    return d.withColumn("more", F.when(F.size("more") > 0, free).otherwise(F.col("more"))).drop(*[f"_{k}" for k in PATTERNS])


def estimate(counts: list[tuple[str, tuple, int]]) -> tuple[dict, dict, dict]:
    """Expectation-maximisation over (kind, votes, count): per kind prior, reliabilities, posteriors.

    A labeler's reliability is the share of its votes that agree with the truth, for true and for false
    spans; labelers are taken to be no worse than chance, and an abstention says nothing.
    """
    prior, rate, post = {}, {}, {}
    for kind in sorted({k for k, _, _ in counts}):
        rows = [(v, n) for k, v, n in counts if k == kind]
        q = [1 / (1 + math.exp(-sum(v))) for v, _ in rows]
        p, agree = 0.5, []
        for _ in range(ROUNDS):
            p = (1 + sum(a * n for a, (_, n) in zip(q, rows, strict=True))) / (2 + sum(n for _, n in rows))
            agree = []
            for j in range(len(VOTES)):
                of = []
                for y, vote in ((0, -1), (1, 1)):
                    weight = [(v[j], n * (a if y else 1 - a)) for a, (v, n) in zip(q, rows, strict=True) if v[j]]
                    # a few imagined votes, most of them right, stand for what is not seen
                    right = (5.0 + sum(x for v, x in weight if v == vote)) / (6.0 + sum(x for _, x in weight))
                    of.append(max(0.5, right))
                agree.append(tuple(of))
            new = []
            for v, _ in rows:
                z = math.log(p / (1 - p))
                for (no, yes), x in zip(agree, v, strict=True):
                    z += math.log(yes / (1 - no)) if x > 0 else math.log((1 - yes) / no) if x < 0 else 0.0
                new.append(1 / (1 + math.exp(-max(-50.0, min(50.0, z)))))
            q = new
        prior[kind], rate[kind] = p, agree
        post.update({(kind, v): a for a, (v, _) in zip(q, rows, strict=True)})
    return prior, rate, post


def train(rows: list[tuple[str, tuple, tuple, int]], post: dict) -> dict:
    """Logistic regression of the posteriors on kind, votes and shape, weighted by counts."""
    def names(kind, votes, shape):
        return [f"kind={kind}", *[f"{n}={v}" for n, v in zip(VOTES, votes, strict=True) if v],
                *[f"{kind}:{n}={v}" for n, v in zip(("size", "digits"), shape, strict=True)]]
    data = [(names(k, v, s), post[k, v], n) for k, v, s, n in rows]
    total = sum(n for _, _, n in data) or 1
    w: dict[str, float] = {}
    grads: dict[str, float] = {}
    for _ in range(400):
        g: dict[str, float] = {}
        for f, y, n in data:
            p = 1 / (1 + math.exp(-max(-50.0, min(50.0, sum(w.get(x, 0.0) for x in f)))))
            for x in f:
                g[x] = g.get(x, 0.0) + n * (y - p) / total
        for x, v in g.items():
            v -= 1e-4 * w.get(x, 0.0)
            grads[x] = grads.get(x, 1e-8) + v * v
            w[x] = w.get(x, 0.0) + 0.5 * v / math.sqrt(grads[x])
    return w


def _logit(s, w: dict):
    """The classifier's score of a candidate with its votes as a column; below 0 if no labeler speaks for it."""
    kind = s["kind"]

    def pick(column, prefix, values, condition=None):
        out = F.lit(0.0)
        for v in values:
            if weight := w.get(f"{prefix}={v}"):
                hit = (column == v) if condition is None else (column == v) & condition
                out = F.when(hit, F.lit(weight)).otherwise(out)
        return out
    z = pick(kind, "kind", ADDED)
    for n in VOTES:
        z = z + pick(s[n], n, (-1, 1))
    for k in ADDED:
        z = z + pick(s["size"], f"{k}:size", range(6), kind == k) + pick(s["digits"], f"{k}:digits", range(5), kind == k)
    return F.when(F.greatest(*[s[n] for n in VOTES]) > 0, z).otherwise(-1.0)


def ballots(found: DataFrame) -> DataFrame:
    """``spans`` with the votes on each candidate in ``more`` and on the base spans in ``base_votes``."""
    def voted(s, *fields):
        return F.struct(s["kind"].alias("kind"), *[s[f].alias(f) for f in fields],
                        *[c.cast("int").alias(n) for n, c in _votes(s, F.col("text")).items()])
    return (found.withColumn("more", F.transform("more", lambda s: voted(s, "s", "e", "m")))
            .withColumn("base_votes", F.transform("base", lambda s: voted(s))))


def vote_counts(voted: DataFrame) -> list[tuple[str, tuple, tuple, int]]:
    """(kind, votes, shape, number of spans) over the table: as many rows as there are patterns."""
    fields = ("kind", *VOTES, "size", "digits")
    both = F.concat("base_votes", F.transform("more", lambda s: F.struct(*[s[f].alias(f) for f in fields])))
    s = voted.select(F.explode(both).alias("s")).select("s.*")
    rows = s.groupBy(*fields).agg(F.count(F.lit(1)).alias("n")).collect()
    return sorted((r["kind"], tuple(r[v] for v in VOTES), (r["size"], r["digits"]), r["n"]) for r in rows)


def model(voted: DataFrame) -> dict:
    """Fit on the vote and shape patterns of all spans of the table; the driver gets their counts."""
    rows = vote_counts(voted)
    totals: dict = {}
    for k, v, _, n in rows:
        totals[k, v] = totals.get((k, v), 0) + n
    _, _, post = estimate([(k, v, n) for (k, v), n in sorted(totals.items())])
    return train(rows, post)


def detect(docs: DataFrame, *keep: str) -> DataFrame:
    """The columns ``keep``, text, ``base`` spans and the accepted ``more`` (kind, s, e, m)."""
    voted = stage(ballots(spans(docs, *keep)), "spans")
    w = model(voted)
    accepted = F.filter("more", lambda s: _logit(s, w) >= 0)
    return voted.withColumn("more", F.transform(accepted, lambda s: F.struct(*[s[f].alias(f) for f in ("kind", "s", "e", "m")]))).drop("base_votes")


def _of(array, kind: str):
    return F.filter(array, lambda s: s["kind"] == kind)


def _listed(array, kinds):
    """kind:start:end by kind as listed, then start."""
    def one(kind):
        places = F.array_sort(F.transform(_of(array, kind), lambda s: F.struct(s["s"], s["e"])))
        return F.transform(places, lambda p: F.concat(F.lit(f"{kind}:"), p["s"].cast("string"), F.lit(":"), p["e"].cast("string")))
    return F.array_join(F.concat(*[one(k) for k in kinds]), ",")


def report(docs: DataFrame) -> DataFrame:
    """Counts and places of the spans of every document."""
    d = detect(documents(docs).select(F.col("doc_id").cast("long"), "text"), "doc_id")
    base = _listed(F.col("base"), BASE)
    return d.select(
        "doc_id", *[F.size(_of(F.col("base"), k)).cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(base.cast("binary"), 256).alias("base_sha256"),
        _listed(F.concat("base", "more"), BASE + ADDED).alias("spans"), F.size("more").cast("long").alias("n_added"))


def redact(docs: DataFrame) -> DataFrame:
    """The documents with each span replaced by its kind in brackets; overlapping spans become one.

    A null text becomes an empty one.
    """
    names = text_columns(docs)
    d = detect(packed(docs, *names), *names[1:], "other_columns")
    ordered = F.array_sort(F.transform(F.concat("base", "more"), lambda s: F.struct(s["s"].alias("s"), (-s["e"]).alias("e"), s["kind"].alias("kind"))))

    def step(acc, s):
        fresh = s["s"] >= acc["pos"]
        text = F.when(fresh, F.concat(acc["out"], F.substring(F.col("text"), acc["pos"] + 1, s["s"] - acc["pos"]),
                                      F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["pos"], -s["e"]).alias("pos"), text.alias("out"))
    start = F.struct(F.lit(0).alias("pos"), F.lit("").alias("out"))
    whole = F.aggregate(ordered, start, step, lambda a: F.concat(
        a["out"], F.substring(F.col("text"), a["pos"] + 1, F.length("text"))))
    d = d.withColumn("text", F.when(F.size(ordered) > 0, whole).otherwise(F.col("text")))
    if "n_chars" in names:
        d = d.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return unpacked(d, docs, *names)
