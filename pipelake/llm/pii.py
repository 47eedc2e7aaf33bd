r"""Personal data by candidate gradient boosting, in DataFrame functions only.

1. Base finders (email, ip, card, phone) give validated spans that always stay.
2. High-recall generators (``number``, ``contact``, ``secret``) propose further spans, which may overlap. None starts or ends
   inside a run of letters and digits: a key-like token is proposed whole or not at all.
3. Boosted trees score each proposal from its format and context. They learn from a bounded sample of documents, and only from
   such proposals as may be added. Positives are the sample's base phones and addresses in their places, rewritten without "+"
   or "@", and hash digests in many forms, planted in the sample's texts behind a name such as "token ="; a few built-in sentences (SEEDS) stand in
   where the sample has none. Digests behind a name such as "commit" are planted as negatives. Other negatives are proposals clear of the base
   spans that a rule tells to be something else (``is_other``); what no rule tells is left out. Spark counts them by feature
   vector; the features have a few bins each, and the trees are fitted on those counts.
4. On the calibration fold, labelled alike, each generator gets the lowest threshold that keeps its precision; proposals above
   it that touch no base span are added, and secrets that hold one whole. A generator without such a threshold adds nothing.

Offsets are code points, end exclusive. Every pattern runs in linear time: runs are possessive and start at their edge. Null
texts count as empty. Rows are independent, so repeated rows, ties and extra columns need no care.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pipelake.llm.common import hash_sample, let, sample_share

KINDS = ("email", "ip", "card", "phone", "number", "contact", "secret")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "number": r"(?<![0-9A-Za-z])(?:\+|\()?[0-9](?:[\x20().+/-]{0,2}+[0-9]){5,40}+(?![0-9A-Za-z])",
    "contact": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+(?:@|\x20?[(\[]at[)\]]\x20?|\x20at\x20)[A-Za-z0-9-]{1,63}+(?:(?:\.|\x20?[(\[]dot[)\]]\x20?|\x20dot\x20)[A-Za-z0-9-]{1,63}+){1,8}+",
    "secret": r"(?<![A-Za-z0-9_+/=-])[A-Za-z0-9_+/-]{16,}+={0,2}+(?![A-Za-z0-9_+/=-])",
}
CONTEXT = r"(?i)(phone|tel|call|mobile|fax|card|visa|credit|account|mail|contact|write|ip|address|id|no)[^0-9A-Za-z]*$"
#: Words that introduce a secret, with what may stand between them and it.
NAMED = r"(?i)(token|secret|passw(or)?d|passphrase|pwd|api[_-]?key|access[_-]?key|private[_-]?key|key|credentials?|bearer|authorization)[\"'`]?[\x20]*[:=]{0,2}[\x20]*[\"'`]?$"
FEATURES = ("kind", "digits", "marks", "groups", "last", "plus", "paren", "letters", "left", "right", "context", "spelt", "size", "turns", "quoted", "named")
SPELT = r"[(\[](?:at|dot)[)\]]|\x20dot\x20"
MONTH, DAY, YEAR = "(?:0?[1-9]|1[0-2])", "(?:0?[1-9]|[12][0-9]|3[01])", "(?:19|20)[0-9]{2}"
#: Dates, spans of years, versions, decimals.
OTHER_NUMBER = rf"^(?:{YEAR}[-./ ]{MONTH}[-./ ]{DAY}(?![0-9])|(?:{DAY}[-./ ]{MONTH}|{MONTH}[-./ ]{DAY})[-./ ]{YEAR}(?![0-9])|{YEAR}[-/ ]{{1,3}}{YEAR}$|[0-9]{{1,3}}(?:\.[0-9]{{1,3}}){{3}}$|[0-9]+\.[0-9]+$)"
#: Built-in sentences with base spans, and with what is none: (calibration fold?, text).
SEEDS = tuple(
    (i // 12 % 2 == 1, f"please {lead} {what} today")
    for i in range(48)
    for lead in (("call", "and", "Mobile:", "mail")[i % 4],)
    for what in (
        f"+1 {201 + 17 * i} 555 {1000 + 211 * i}",
        ("ann", "ann.lee", f"ann{i}", f"ann.lee{i}")[i // 4 % 3] + "@" + ("example.com", "mail.example.org", f"mail{i}.example.org")[i // 24 + i % 2],
        f"look at {('example.com', 'www.example.org', f'www{i}.example.org')[i % 3]} or a dot there",
    )
)
SPAN = "array<struct<start:int,kind:int,end:int,text:string>>"


def exclusive_sums(values: Column, block: int = 64) -> Column:
    """Sums of the values before each place. Summed in blocks, so that the arrays that grow stay short."""
    grow = lambda x: F.aggregate(x, F.array(F.lit(0)), lambda a, v: F.concat(a, F.array(F.element_at(a, -1) + v)))
    starts = F.sequence(F.lit(0), F.greatest(F.ceil(F.size(values) / block).cast("int") - 1, F.lit(0)))
    blocks = F.transform(starts, lambda b: grow(F.slice(values, b * block + 1, block)))

    def joined(parts: Column) -> Column:
        before = F.slice(grow(F.transform(parts, lambda p: F.element_at(p, -1))), 1, F.size(parts))
        return F.flatten(F.zip_with(parts, before, lambda p, o: F.transform(F.slice(p, 1, F.size(p) - 1), lambda x: x + o)))

    return let(blocks, joined)


def find(text: Column, kind: str, guard: Column) -> Column:
    """Leftmost non-overlapping matches of a kind, if the cheap guard says that there may be any."""
    pattern = PATTERNS[kind]

    def placed(m: Column) -> Column:
        def with_gaps(g: Column) -> Column:
            steps = F.zip_with(m, F.slice(g, 1, F.size(m)), lambda x, y: F.length(x) + F.length(y))
            return F.transform(
                F.arrays_zip(m.alias("m"), F.slice(g, 1, F.size(m)).alias("g"), exclusive_sums(steps).alias("s")),
                lambda z: F.struct(
                    (z["s"] + F.length(z["g"])).alias("start"),
                    F.lit(KINDS.index(kind)).alias("kind"),
                    (z["s"] + F.length(z["g"]) + F.length(z["m"])).alias("end"),
                    z["m"].alias("text"),
                ),
            )

        return F.when(F.size(m) > 0, let(F.split(text, pattern, -1), with_gaps)).otherwise(F.array().cast(SPAN))

    return F.when(guard, let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)).otherwise(F.array().cast(SPAN))


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substr(digits, n - i + 1, F.lit(1)).cast("int") * (F.lit(2) - i % 2)
        return total + d - F.when(d > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def base_spans(text: Column) -> Column:
    """The validated spans, by start and then kind."""
    digit, dot = text.rlike("[0-9][\x20-]?[0-9]"), text.rlike(r"[0-9]\.[0-9]")
    email = find(text, "email", F.instr(text, "@") > 0)
    ip = F.filter(find(text, "ip", dot), lambda s: F.forall(F.split(s["text"], r"\."), lambda p: p.rlike(r"^0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])$")))

    def is_card(s: Column) -> Column:
        digits = F.regexp_replace(s["text"], "[^0-9]", "")
        return F.when(F.length(digits).between(12, 19), _luhn(digits)).otherwise(False)

    card = F.filter(find(text, "card", digit), is_card)
    phone = F.filter(find(text, "phone", F.instr(text, "+") > 0), lambda s: F.length(F.regexp_replace(s["text"], "[^0-9]", "")).between(9, 15))
    return F.sort_array(F.concat(email, ip, card, phone))


def proposed_spans(text: Column) -> Column:
    """What the high-recall generators propose."""
    number = find(text, "number", text.rlike("[0-9][\x20().+/-]?[0-9]"))
    at = (F.instr(text, "@") > 0) | (F.instr(text, "at)") > 0) | (F.instr(text, "at]") > 0) | (F.instr(text, " dot ") > 0)
    secret = F.filter(find(text, "secret", text.rlike(PATTERNS["secret"])), lambda s: s["text"].rlike("[0-9]") & s["text"].rlike("[A-Za-z]"))
    return F.sort_array(F.concat(number, find(text, "contact", at), secret))


def _bin(value: Column, edges: tuple[int, ...]) -> Column:
    """Number of edges that the value reaches."""
    return sum((F.when(value >= e, 1).otherwise(0) for e in edges), F.lit(0))


def _near(char: Column) -> Column:
    return F.when(char == "", 0).when(char.rlike(r"^[\x20\x09-\x0D]"), 1).when(char.rlike(r"^[0-9A-Za-z]"), 2).otherwise(3)


def span_features(text: Column, span: Column) -> Column:
    """Struct of small integers. Products of the bins bound the number of different vectors, whatever the corpus."""
    s = span["text"]
    before = F.substr(text, F.greatest(span["start"] - 24, F.lit(0)) + 1, F.least(span["start"], F.lit(24)))
    values = {
        "kind": span["kind"],
        "digits": _bin(F.length(F.regexp_replace(s, "[^0-9]", "")), (1, 6, 9, 12, 16, 17)),
        "marks": _bin(F.length(F.regexp_replace(s, "[0-9A-Za-z]", "")), (1, 2, 3, 5)),
        "groups": _bin(F.regexp_count(s, F.lit("[0-9]+")), (2, 3, 4, 5)),
        "last": _bin(F.length(F.regexp_extract(s, "([0-9]*)$", 1)), (2, 3, 4, 5)),
        "plus": F.when(s.startswith("+"), 1).otherwise(0),
        "paren": F.when(F.contains(s, F.lit("(")), 1).otherwise(0),
        "letters": F.when(s.rlike("[A-Za-z]"), 1).otherwise(0),
        "left": _near(F.when(span["start"] == 0, "").otherwise(F.substr(text, F.greatest(span["start"], F.lit(1)), F.lit(1)))),
        "right": _near(F.substr(text, span["end"] + 1, F.lit(1))),
        "context": F.when(before.rlike(CONTEXT), 1).otherwise(0),
        "spelt": F.when(s.rlike(SPELT), 1).otherwise(0),
        "size": _bin(F.length(s), (20, 24, 32, 40, 64)),
        # Changes between letters and digits: a random token has many, a word with a year one or two.
        "turns": _bin(F.regexp_count(s, F.lit("(?<=[A-Za-z])[0-9]|(?<=[0-9])[A-Za-z]")), (2, 4, 7, 12)),
        "quoted": F.when(before.rlike("[\"'`]$"), 1).otherwise(0),
        "named": F.when(before.rlike(NAMED), 1).otherwise(0),
    }
    return F.struct(*[values[f].cast("int").alias(f) for f in FEATURES])


def _touches(span: Column, others: Column) -> Column:
    return F.exists(others, lambda o: (o["start"] < span["end"]) & (span["start"] < o["end"]))


def is_other(span: Column, x: Column) -> Column:
    """A proposal clear of the base spans is no personal data: part of a longer word, of a wrong length, a date or the like, bare
    digits that no word introduces, or "look at example.com"."""
    s = span["text"]
    digits = F.regexp_replace(s, "[^0-9]", "")
    card = F.when(F.length(digits).between(12, 19), _luhn(digits)).otherwise(False)
    number = (x["left"] == 2) | (x["right"] == 2) | s.rlike(OTHER_NUMBER) | (s.rlike("^[0-9]+$") & (x["context"] == 0)) | (~F.length(digits).between(7, 15) & ~card)
    contact = ~s.rlike("[A-Za-z]{2,}$") | ~(F.contains(s, F.lit("@")) | s.rlike(SPELT))
    secret = (x["named"] == 0) & (x["turns"] < 2)
    return F.when(span["kind"] == KINDS.index("number"), number).when(span["kind"] == KINDS.index("secret"), secret).otherwise(contact)


def rewritten(span: Column) -> Column:
    """Forms (kind, lead, text) of a base phone without its "+" and of a base address without its "@"; none for other kinds."""
    form = lambda kind, lead, *text: F.struct(F.lit(KINDS.index(kind)).alias("kind"), F.lit(lead).alias("lead"), F.concat(*[F.lit(t) if isinstance(t, str) else t for t in text]).alias("text"))
    digits = F.right(F.regexp_replace(span["text"], "[^0-9]", ""), F.lit(10))
    a, b, c = F.substr(digits, F.lit(1), F.length(digits) - 7), F.substr(digits, F.length(digits) - 6, F.lit(3)), F.right(digits, F.lit(4))
    local = F.array(
        form("number", "", "(", a, ") ", b, "-", c), form("number", "", a, "-", b, "-", c), form("number", "", a, ".", b, ".", c),
        form("number", "", a, " ", b, " ", c), form("number", "call ", b, "-", c), form("number", "call ", digits),
    )
    name, host = F.split_part(span["text"], F.lit("@"), F.lit(1)), F.split_part(span["text"], F.lit("@"), F.lit(2))
    dots = lambda mark: F.replace(host, F.lit("."), F.lit(mark))
    spelt = F.array(*[form("contact", "", name, at, dots(dot)) for at, dot in ((" (at) ", " dot "), (" [at] ", " [dot] "), ("(at)", "."), ("(at)", "(dot)"), (" (at) ", "."), (" at ", " dot "))])
    return F.when(span["kind"] == KINDS.index("phone"), local).when(span["kind"] == KINDS.index("email"), spelt)


#: What stands before a planted secret, and before a digest that is none.
LEADS = (' token = "', " api_key: ", ' password="', " secret=", " Bearer ", ' "access_key": "', " key = '")
PLAIN_LEADS = (" commit ", " sha256:", " checksum ", " build ", ' etag "', " at /blob/", " revision ")


def planted(text: Column) -> Column:
    """(lead, text, y): one secret and one digest that is none, their form and lead chosen by the text's hash."""
    pick = lambda seed, n: F.pmod(F.xxhash64(text, F.lit(seed)), F.lit(n)).cast("int")
    digests = lambda seed: F.array(
        F.md5(F.concat(text, F.lit(f"{seed}"))), F.sha1(F.concat(text, F.lit(f"{seed}"))), F.sha2(F.concat(text, F.lit(f"{seed}")), 256), F.upper(F.sha1(F.concat(F.lit(f"{seed}"), text)))
    )
    raw = F.regexp_replace(F.base64(F.unhex(F.sha2(F.concat(text, F.lit("raw")), 256))), "[^A-Za-z0-9]", "")
    keys = F.concat(digests(1), F.array(raw, F.concat(F.lit("sk_live_"), F.left(raw, F.lit(24))), F.concat(F.lit("AKIA"), F.upper(F.left(raw, F.lit(16)))), F.left(raw, F.lit(32))))
    secret = F.struct(F.get(F.array(*map(F.lit, LEADS)), pick(2, len(LEADS))).alias("lead"), F.get(keys, pick(3, 8)).alias("text"), F.lit(1).alias("y"))
    other = F.struct(F.get(F.array(*map(F.lit, PLAIN_LEADS)), pick(4, len(PLAIN_LEADS))).alias("lead"), F.get(digests(5), pick(6, 4)).alias("text"), F.lit(0).alias("y"))
    return F.array(secret, other)


#: Forms of each span, so a negative counts as often.
FORMS = 6


@dataclass(frozen=True)
class Tree:
    """A regression tree: a leaf value, or a question feature <= limit with two branches."""

    value: float = 0.0
    feature: str = ""
    limit: int = 0
    yes: Tree | None = None
    no: Tree | None = None

    def at(self, x: dict[str, int]) -> float:
        return self.value if not self.feature else (self.yes if x[self.feature] <= self.limit else self.no).at(x)

    def column(self, x: Column) -> Column:
        return F.lit(self.value) if not self.feature else F.when(x[self.feature] <= self.limit, self.yes.column(x)).otherwise(self.no.column(x))


@dataclass(frozen=True)
class SpanModel:
    trees: tuple[Tree, ...]
    thresholds: dict[int, float]

    def accepts(self, x: Column) -> Column:
        score = sum((t.column(x) for t in self.trees), F.lit(0.0))
        return sum((F.when((x["kind"] == k) & (score >= limit), 1).otherwise(0) for k, limit in self.thresholds.items()), F.lit(0)) > 0


def _tree(rows: list[tuple[dict, float, float]], depth: int) -> Tree:
    """Newton tree on (features, gradient, hessian) rows."""
    gain = lambda g, h: g * g / (h + 1.0)
    g, h = sum(r[1] for r in rows), sum(r[2] for r in rows)
    best = (1e-6, "", 0)
    for feature in FEATURES if depth else ():
        sums: dict[int, list[float]] = {}
        for x, a, b in rows:
            cell = sums.setdefault(x[feature], [0.0, 0.0])
            cell[0] += a
            cell[1] += b
        left_g = left_h = 0.0
        for value in sorted(sums)[:-1]:
            left_g += sums[value][0]
            left_h += sums[value][1]
            better = gain(left_g, left_h) + gain(g - left_g, h - left_h) - gain(g, h)
            if better > best[0] + 1e-9:
                best = (better, feature, value)
    if not best[1]:
        return Tree(value=0.3 * g / (h + 1.0))
    _, feature, limit = best
    return Tree(0.0, feature, limit, _tree([r for r in rows if r[0][feature] <= limit], depth - 1), _tree([r for r in rows if r[0][feature] > limit], depth - 1))


def fit_spans(counts: list[tuple[dict, bool, int, int]], *, rounds: int = 20, depth: int = 3, precision: float = 0.9, least: int = 20) -> SpanModel:
    """Model from (features, calibration fold?, proposals, positives) counts."""
    train = [(x, n, p) for x, fold, n, p in counts if not fold]
    scores, trees = [0.0] * len(train), []
    for _ in range(rounds if train else 0):
        chance = [1 / (1 + math.exp(-s)) for s in scores]
        tree = _tree([(x, p - n * q, n * q * (1 - q)) for (x, n, p), q in zip(train, chance, strict=True)], depth)
        trees.append(tree)
        scores = [s + tree.at(x) for s, (x, _, _) in zip(scores, train, strict=True)]
    thresholds: dict[int, float] = {}
    for kind in {x["kind"] for x, fold, _, _ in counts if fold}:
        held = sorted(((sum(t.at(x) for t in trees), n, p) for x, fold, n, p in counts if fold and x["kind"] == kind), key=lambda r: -r[0])
        total = good = 0
        for i, (score, n, p) in enumerate(held):
            total, good = total + n, good + p
            if (i + 1 == len(held) or held[i + 1][0] < score) and total >= least and good >= precision * total:
                thresholds[kind] = score - 1e-9
    return SpanModel(tuple(trees), thresholds)


def train(docs: DataFrame, *, key: str, text: str, sample_docs: int = 4000, **options) -> SpanModel:
    """Fit on about ``sample_docs`` documents, a quarter of them for calibration."""
    sample = docs.where(hash_sample(F.col(key).cast("string"), sample_share(docs.count(), sample_docs)))
    rows = sample.select((F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit(11)), F.lit(4)) == 0).alias("fold"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    seeds = docs.sparkSession.range(1).select(F.inline(F.array(*[F.struct(F.lit(fold).alias("fold"), F.lit(t).alias("t")) for fold, t in SEEDS])))
    found = rows.union(seeds).select("fold", "t", base_spans(F.col("t")).alias("base"))
    clear = found.select("fold", "t", F.explode(F.filter(proposed_spans(F.col("t")), lambda s: ~_touches(s, F.col("base")))).alias("s"))
    other = clear.withColumn("x", span_features(F.col("t"), F.col("s"))).where(is_other(F.col("s"), F.col("x"))).select("fold", "x", F.lit(FORMS).alias("w"), F.lit(0).alias("y"))
    plain = found.select("fold", "t", F.explode("base").alias("b"))
    before = F.substr("t", F.greatest(F.col("b.start") - 30, F.lit(0)) + 1, F.least("b.start", F.lit(30)))
    forms = plain.select("fold", before.alias("before"), F.substr("t", F.col("b.end") + 1, F.lit(30)).alias("after"), F.explode(rewritten(F.col("b"))).alias("f"))
    told = forms.select("fold", "f.kind", F.concat("before", "f.lead", "f.text", "after").alias("t"), F.length(F.concat("before", "f.lead")).alias("start"), F.length("f.text").alias("n"))
    there = F.filter(proposed_spans(F.col("t")), lambda s: (s["kind"] == F.col("kind")) & (s["start"] < F.col("start") + F.col("n")) & (F.col("start") < s["end"]))
    personal = told.select("fold", "t", F.explode(there).alias("s")).select("fold", span_features(F.col("t"), F.col("s")).alias("x"), F.lit(1).alias("w"), F.lit(1).alias("y"))
    around = found.select("fold", F.left("t", F.lit(30)).alias("before"), F.substr("t", F.lit(31), F.lit(30)).alias("after"), F.explode(planted(F.col("t"))).alias("f"))
    quote = F.when(F.col("f.lead").rlike("[\"']$"), F.right("f.lead", F.lit(1))).otherwise("")
    keyed = around.select("fold", F.concat("before", "f.lead", "f.text", quote, F.lit(" "), "after").alias("t"), F.length(F.concat("before", "f.lead")).alias("start"), "f.text", "f.y")
    whole = F.filter(proposed_spans(F.col("t")), lambda s: (s["kind"] == KINDS.index("secret")) & (s["start"] == F.col("start")))
    secrets = keyed.select("fold", "t", "y", F.explode(whole).alias("s")).select("fold", span_features(F.col("t"), F.col("s")).alias("x"), F.lit(1).alias("w"), "y")
    counted = other.union(personal).union(secrets).groupBy("x", "fold").agg(F.sum("w").alias("n"), F.sum("y").alias("p"))
    rows = [(r.x.asDict(), bool(r.fold), r.n, r.p) for r in counted.collect()]
    return fit_spans(sorted(rows, key=lambda r: (tuple(r[0].values()), r[1])), **options)


def find_personal_data(docs: DataFrame, *, key: str = "doc_id", text: str = "text", sample_docs: int = 4000) -> DataFrame:
    """docs with ``base`` and ``added``, arrays of (start, kind number, end, text); columns of those names are replaced."""
    model = train(docs, key=key, text=text, sample_docs=sample_docs)
    value = F.coalesce(F.col(text), F.lit(""))
    found = docs.withColumn("base", base_spans(value))
    if not model.thresholds:
        return found.withColumn("added", F.array().cast(SPAN))
    # A secret may hold base spans (digits of a key can pass for a card); what else touches one is not added.
    held = lambda s: (s["kind"] == KINDS.index("secret")) & F.forall("base", lambda o: (o["end"] <= s["start"]) | (s["end"] <= o["start"]) | ((s["start"] <= o["start"]) & (o["end"] <= s["end"])))
    free = F.filter(proposed_spans(value), lambda s: ~_touches(s, F.col("base")) | held(s))
    return found.withColumn("added", F.filter(free, lambda s: let(span_features(value, s), model.accepts)))


def spans_text(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets; of overlapping spans the earliest counts and covers all."""

    def merge(ordered: Column) -> Column:
        start = F.array().cast("array<struct<start:int,kind:int,end:int>>")

        def step(done: Column, s: Column) -> Column:
            last = F.try_element_at(done, F.lit(-1))
            wider = F.struct(last["start"].alias("start"), last["kind"].alias("kind"), F.greatest(last["end"], s["end"]).alias("end"))
            own = F.struct(s["start"], s["kind"], s["end"])
            return F.when(last.isNotNull() & (s["start"] < last["end"]), F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(wider))).otherwise(F.concat(done, F.array(own)))

        return F.aggregate(ordered, start, step)

    def write(m: Column) -> Column:
        names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
        parts = F.transform(
            m,
            lambda s, i: F.concat(
                let(F.coalesce(F.get(m, i - 1)["end"], F.lit(0)), lambda a: F.substr(text, a + 1, s["start"] - a)), F.get(names, s["kind"])
            ),
        )
        return F.concat(F.array_join(parts, ""), F.substr(text, F.element_at(m, -1)["end"] + 1, F.length(text)))

    return F.when(F.size(spans) == 0, text).otherwise(let(merge(F.sort_array(spans)), write))


def redact(docs: DataFrame, *, key: str = "doc_id", text: str = "text", sample_docs: int = 4000) -> DataFrame:
    """docs with base and added spans blanked out in the text; null texts stay null."""
    packed = docs.select(F.struct(*docs.columns).alias("_doc"), F.col(key).alias("_key"), F.col(text).alias("_text"))
    found = find_personal_data(packed, key="_key", text="_text", sample_docs=sample_docs)
    clean = redacted(F.col("_text"), F.concat("base", "added"))
    return found.select(F.col("_doc").withField(text, clean).alias("_doc")).select("_doc.*")
