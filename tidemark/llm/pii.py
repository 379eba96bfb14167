"""Personal data: base patterns, plus candidates that boosted trees accept.

Wide patterns propose spans, which may overlap: anything written like an address
or like a number of seven digits or more. Boosted trees judge a candidate by its
form (digits, separators, groups, check digit) and its surroundings. They learn
from all base spans written in other forms (without the country code, spelt out,
other separators), from such forms spoilt, and from candidates that context words
or their form decide; whether a base span lies on a candidate is never its label.
A cut per kind is calibrated on held-out spans. Accepted
candidates are added where no base span lies. Patterns, features and trees are column expressions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import let, shield, text_of
from tidemark.session import persist_table

KINDS = ("email", "ip", "card", "phone")
# The base patterns, written so that no text makes them slow: quantifiers are
# possessive, and a run is only tried at its start or where a match ended. Long
# digit runs are cut off by the bound of a card's length.
_LOCAL, _LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_LABEL}++(?:\.{_LABEL}++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
# Candidates: addresses with a spelt-out sign, and numbers with any common separators.
_AT, _DOT = r"\x20?(?:@|[(\[]at[)\]])\x20?", r"\x20?(?:\.|[(\[]dot[)\]])\x20?"
CANDIDATES = {
    "address": rf"(?<!{_LOCAL}){_LOCAL}{{1,64}}+{_AT}{_LABEL}{{1,63}}+(?:{_DOT}{_LABEL}{{1,63}}+){{1,8}}+",
    "number": r"(?<![0-9A-Za-z])[+(]?[0-9](?:[\x20()./:-]{0,2}[0-9]){6,18}+(?![0-9A-Za-z])",
}
SORT_HINTS = {"address": r"@|[(\[]at[)\]]", "number": "[0-9]"}
CONTEXT_CHARS = 24
# Elements of an array that are folded at once.
SCAN_BLOCK = 128
TREES, DEPTH, SEED = 20, 3, 7
# Sorts of equal examples that a task fits on, and the least number of bins of a feature.
FIT_ROWS, BINS = 100_000, 256
PRECISION = 0.995
# Three groups as national numbers have them. Of its own this is no evidence for or against.
PHONE_FORM = r"^\(?[0-9]{2,4}\)?[\x20.-]{1,2}[0-9]{3,4}[\x20.-][0-9]{3,4}$"
CALL_WORDS, MAIL_WORDS = "(?:^|[^a-z])(?:phone|tel|call|mobile|fax)", "mail|contact|write to"
FEATURES = (
    "address", "length", "digits", "letters", "spaces", "dots", "dashes", "brackets", "colons", "groups",
    "longest_group", "check_digit", "small_parts", "spelt", "named", "number_words", "mail_words", "before_word", "after_word",
)


def scan_before(values: Column, step: Callable[[Column, Column], Column], first: int) -> Column:
    """``step`` folded over the elements before each one, ``first`` where there is none.

    Growing an array copies it, so blocks are folded each on its own and then
    started from the fold of the blocks before: long arrays take little more than linear time.
    """
    def fold(x: Column) -> Column:
        return F.aggregate(x, F.array(F.lit(first)), lambda a, v: F.concat(a, F.array(step(F.element_at(a, -1), v))))

    def whole(v: Column) -> Column:
        last = F.floor((F.size(v) - 1) / SCAN_BLOCK).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), last), lambda k: fold(F.slice(v, k * SCAN_BLOCK + 1, F.lit(SCAN_BLOCK))))

        def joined(b: Column) -> Column:
            starts = fold(F.transform(b, lambda x: F.element_at(x, -1)))
            return let(F.struct(b.alias("b"), starts.alias("s")), lambda both: F.flatten(F.transform(
                both["b"], lambda x, k: F.transform(F.slice(x, F.lit(1), F.size(x) - 1), lambda y: step(F.get(both["s"], k), y))
            )))

        return F.when(F.size(v) == 0, F.array().cast("array<int>")).otherwise(let(blocks, joined))

    return let(values, whole)


def find_spans(text: Column, pattern: str) -> Column:
    """Array of (start, end, found, before, after) of the matches: code points, and what surrounds them.

    Splitting at the pattern yields what lies between the matches that
    extraction yields, so lengths add up to positions. ``before`` are the last
    CONTEXT_CHARS ahead of a match (only for matches of seven characters or more,
    else maybe fewer), ``after`` is the next character.
    """
    pieces, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    empty = F.array().cast("array<struct<start:int,end:int,found:string,before:string,after:string>>")

    def place(both: Column) -> Column:
        piece, match = lambda i: F.get(both["pieces"], i), lambda i: F.get(both["found"], i)
        taken = F.transform(both["found"], lambda x, i: F.length(piece(i)) + F.length(x))

        def spans(at: Column) -> Column:
            def span(x: Column, i: Column) -> Column:
                start = F.get(at, i) + F.length(piece(i))
                # Three matches and what lies between them reach back over the whole context.
                ahead = F.concat_ws("", *[c for k in (3, 2, 1) for c in (piece(i - k), match(i - k))], piece(i))
                return F.struct(
                    start.alias("start"), (start + F.length(x)).alias("end"), x.alias("found"),
                    F.substring(ahead, -CONTEXT_CHARS, CONTEXT_CHARS).alias("before"),
                    F.substring(F.concat_ws("", piece(i + 1), match(i + 1)), 1, 1).alias("after"),
                )

            return F.transform(both["found"], span)

        return F.when(F.size(both["found"]) == 0, empty).otherwise(let(scan_before(taken, lambda a, x: a + x, 0), spans))

    return let(F.struct(pieces.alias("pieces"), found.alias("found")), place)


def without_overlap(spans: Column, others: Column) -> Column:
    """``spans`` that overlap none of ``others``, by start: both lists are merged and read once each way."""
    far = 2**31 - 1

    def merge(both: Column) -> Column:
        place = lambda x, i: F.struct(x["start"].alias("start"), x["end"].alias("end"), i.alias("i"))
        events = F.sort_array(F.concat(F.transform(both["others"], lambda x: place(x, F.lit(-1))), F.transform(both["spans"], place)))

        def sift(e: Column) -> Column:
            reach = scan_before(F.transform(e, lambda x: F.when(x["i"] < 0, x["end"]).otherwise(0)), F.greatest, 0)
            nearest = scan_before(F.reverse(F.transform(e, lambda x: F.when(x["i"] < 0, x["start"]).otherwise(far))), F.least, far)

            def keep(sides: Column) -> Column:
                n = F.size(e)
                free = lambda x, k: (x["i"] >= 0) & (F.get(sides["reach"], k) <= x["start"]) & (F.get(sides["nearest"], n - 1 - k) >= x["end"])
                return F.transform(F.filter(e, free), lambda x: F.get(both["spans"], x["i"]))

            return let(F.struct(reach.alias("reach"), nearest.alias("nearest")), keep)

        return F.when((F.size(both["spans"]) == 0) | (F.size(both["others"]) == 0), both["spans"]).otherwise(let(events, sift))

    return let(F.struct(spans.alias("spans"), others.alias("others")), merge)


def check_digit_fits(found: Column) -> Column:
    """Luhn's rule over the digits of ``found``."""
    digits = F.split(F.reverse(F.regexp_replace(found, "[^0-9]", "")), "")
    doubled = lambda d: F.when(d > 4, d * 2 - 9).otherwise(d * 2)
    summed = F.aggregate(
        F.transform(F.filter(digits, lambda d: d != ""), lambda d, i: F.when(i % 2 == 1, doubled(d.cast("int"))).otherwise(d.cast("int"))),
        F.lit(0), lambda a, d: a + d,
    )
    return summed % 10 == 0


def _digits(found: Column) -> Column:
    return F.length(F.regexp_replace(found, "[^0-9]", ""))


VALID: dict[str, Callable[[Column], Column]] = {
    "email": lambda found: F.lit(True),
    "ip": lambda found: found.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$"),
    "card": check_digit_fits,
    "phone": lambda found: _digits(found).between(9, 15),
}
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9]", "phone": r"\+[0-9]"}


def found_base(text: Column, kind: str) -> Column:
    """Valid matches of one kind, with what :func:`find_spans` tells of them."""
    kept = F.filter(find_spans(text, PATTERNS[kind]), lambda s: VALID[kind](s["found"]))
    spans = F.transform(kept, lambda s: F.struct(F.lit(kind).alias("kind"), *[s[c].alias(c) for c in ("start", "end", "found", "before", "after")]))
    empty = F.array().cast("array<struct<kind:string,start:int,end:int,found:string,before:string,after:string>>")
    return F.when(text.rlike(HINTS[kind]), spans).otherwise(empty)


def base_spans(text: Column, kind: str) -> Column:
    """(kind, start, end) of the valid matches of one kind."""
    return F.transform(found_base(text, kind), lambda s: F.struct(*[s[c].alias(c) for c in ("kind", "start", "end")]))


def _candidate_features(span: Column, address: Column) -> Column:
    found = span["found"]
    count = lambda p: (F.length(found) - F.length(F.regexp_replace(found, p, ""))).cast("double")
    groups = F.filter(F.split(found, "[^0-9]+"), lambda g: g != "")
    ahead, after = F.lower(span["before"]), span["after"]
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    values = {
        "address": address.cast("double"),
        "length": F.length(found).cast("double"), "digits": count("[0-9]"), "letters": count("[A-Za-z]"),
        "spaces": count("\\x20"), "dots": count("\\."), "dashes": count("-"), "brackets": count("[()]"),
        "colons": count("[:/]"), "groups": F.size(groups).cast("double"),
        "longest_group": F.coalesce(F.array_max(F.transform(groups, lambda g: F.length(g))), F.lit(0)).cast("double"),
        "check_digit": flag(check_digit_fits(found)), "small_parts": flag(VALID["ip"](found)),
        "named": flag(found.rlike("[A-Za-z]{2}$")), "spelt": flag(found.rlike("[(\\[](?:at|dot)[)\\]]")),
        "number_words": flag(ahead.rlike("phone|tel|call|mobile|fax|card|visa|account")), "mail_words": flag(ahead.rlike(MAIL_WORDS)),
        "before_word": flag(ahead.rlike("[a-z0-9]$")), "after_word": flag(after.rlike("[A-Za-z0-9]")),
    }
    return F.array(*[values[f] for f in FEATURES])


def _kind_of(sort: str, found: Column) -> Column:
    if sort == "address":
        return F.lit("email")
    return F.when(found.rlike(r"^[0-9]+(?:\.[0-9]+){3}$"), "ip").when(_digits(found) >= 13, "card").otherwise("phone")


def candidates(text: Column) -> Column:
    """(kind, start, end, found, before, x): proposed spans and their features."""
    empty = F.array().cast("array<struct<kind:string,start:int,end:int,found:string,before:string,x:array<double>>>")

    def of(sort: str) -> Column:
        def described(s: Column) -> Column:
            address = F.lit(sort == "address")
            return F.struct(
                _kind_of(sort, s["found"]).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["found"].alias("found"),
                s["before"].alias("before"), _candidate_features(s, address).alias("x"),
            )

        return F.when(text.rlike(SORT_HINTS[sort]), F.transform(find_spans(text, CANDIDATES[sort]), described)).otherwise(empty)

    return F.concat(*[of(sort) for sort in CANDIDATES])


def _evidence(c: Column) -> Column:
    """1 or 0 where context words or the form decide on a candidate without a base span, else null."""
    found, ahead = c["found"], F.lower(c["before"])
    address = F.when(~found.rlike("[A-Za-z]{2}$"), 0.0).when(ahead.rlike(MAIL_WORDS), 1.0).when(~found.rlike("[(\\[]at[)\\]]"), 0.0)
    phone = F.when(ahead.rlike(CALL_WORDS) & ~found.rlike("[:/]") & _digits(found).between(7, 12), 1.0).when(~found.rlike(PHONE_FORM), 0.0)
    card = F.when(~check_digit_fits(found), 0.0)
    return F.when(c["kind"] == "email", address).when(c["kind"] == "phone", phone).when(c["kind"] == "card", card).otherwise(0.0)


def _rewritten(b: Column) -> Column:
    """Base span ``b`` in other forms (label 1), and in forms that nobody gives such data (label 0)."""
    found = b["found"]
    one = lambda form, label: F.struct(form.alias("found"), F.lit(float(label)).alias("label"))
    empty = F.array().cast("array<struct<found:string,label:double>>")
    local, domain = F.substring_index(found, "@", 1), F.substring_index(found, "@", -1)
    dots = lambda sign: F.regexp_replace(domain, "\\.", sign)
    email = F.array(
        one(F.concat(local, F.lit(" (at) "), dots(" (dot) ")), 1), one(F.concat(local, F.lit("(at)"), domain), 1),
        one(F.concat(local, F.lit(" [at] "), dots("[dot]")), 1), one(F.concat(local, F.lit(" @ "), F.regexp_replace(domain, "[A-Za-z-]+", "5")), 0),
    )
    national = F.regexp_replace(found, r"^\+[0-9]{1,3}[\x20.-]+", "")
    groups = lambda sign: F.regexp_replace(F.regexp_replace(national, "[()]", ""), "[^0-9]+", sign)
    phone = F.when(national.rlike(PHONE_FORM), F.array(
        one(national, 1), *[one(groups(sign), 1) for sign in ("-", ".", " ")], *[one(groups(sign), 0) for sign in (":", "/")],
    )).otherwise(empty)
    digits = F.regexp_replace(found, "[^0-9]", "")
    spoilt = F.concat(F.substring(digits, F.lit(1), F.length(digits) - 1), ((F.substring(digits, -1, 1).cast("int") + 1) % 10).cast("string"))
    fours = lambda d: F.regexp_replace(d, "([0-9]{4})(?=[0-9])", "$1.")
    card = F.array(one(fours(digits), 1), one(fours(spoilt), 0), one(spoilt, 0))
    forms = F.when(b["kind"] == "email", email).when(b["kind"] == "phone", phone).when(b["kind"] == "card", card).otherwise(empty)
    return F.transform(forms, lambda f: F.struct(
        b["kind"].alias("kind"), b["start"].alias("start"), b["end"].alias("end"), f["found"].alias("found"),
        f["label"].alias("label"), b["before"].alias("before"), b["after"].alias("after"), (b["kind"] == "email").alias("address"),
    ))


def examples(text: Column, base: Column) -> Column:
    """(kind, start, end, label, x): rewritten spans of ``base`` (as found), and the other candidates that evidence decides."""
    free = without_overlap(candidates(text), base)
    judged = F.transform(free, lambda c: F.struct(
        c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"), _evidence(c).alias("label"), c["x"].alias("x")
    ))
    planted = F.transform(F.flatten(F.transform(base, lambda b: _rewritten(b))), lambda f: F.struct(
        f["kind"].alias("kind"), f["start"].alias("start"), f["end"].alias("end"), f["label"].alias("label"), _candidate_features(f, f["address"]).alias("x")
    ))
    return F.concat(F.filter(judged, lambda c: c["label"].isNotNull()), planted)


def _tree(node, x: Column) -> Column:
    """One regression tree as nested conditions."""
    if node.subtreeDepth() == 0:
        return F.lit(float(node.prediction()))
    split = node.split()
    return F.when(x[split.featureIndex()] <= float(split.threshold()), _tree(node.leftChild(), x)).otherwise(_tree(node.rightChild(), x))


class Judge:
    """Boosted trees as a column expression, with a cut per kind."""

    def __init__(self, model, cuts: dict[str, float]):
        self.roots = [t._call_java("rootNode") for t in model.trees]
        self.weights, self.cuts = list(model.treeWeights), cuts

    def probability(self, x: Column) -> Column:
        total = F.lit(0.0)
        for root, weight in zip(self.roots, self.weights, strict=True):
            total = total + float(weight) * _tree(root, x)
        return 1 / (1 + F.exp(-2 * total))

    def accepts(self, candidate: Column) -> Column:
        cut = F.lit(2.0)
        for kind, value in self.cuts.items():
            cut = F.when(candidate["kind"] == kind, value).otherwise(cut)
        return self.probability(candidate["x"]) >= cut


def train(docs: DataFrame, precision: float = PRECISION) -> Judge | None:
    """Fit on three quarters of all examples, set the cuts on the rest; None where they are all of one sort.

    Equal examples are one row that weighs their number.
    """
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector

    text = text_of()
    rows = shield(docs).filter(text.rlike(r"[0-9@]|[(\[]at[)\]]")).select("doc_id", text.alias("text")).withColumn("base", F.concat(*[found_base(F.col("text"), k) for k in KINDS]))
    proposed = rows.select("doc_id", F.explode(examples(F.col("text"), F.col("base"))).alias("c")).select(
        "c.kind", "c.label", "c.x", (F.pmod(F.xxhash64("doc_id", "c.start", "c.end", "c.kind"), F.lit(4)) == 0).alias("held")
    )
    counted = proposed.groupBy("held", "kind", "label", "x").agg(F.count(F.lit(1)).cast("double").alias("weight"))
    known = persist_table(counted, "pii-examples")
    fit = known.filter(~F.col("held"))
    if fit.select("label").distinct().count() < 2:
        return None
    sorts = fit.count()
    # In one order, so that sums and with them the trees are the same in every run.
    dealt = fit.repartition(sorts // FIT_ROWS + 1, "label", "x").sortWithinPartitions("kind", "label", "x")
    # Split points are looked for among as many rows as the square of the bins: here among all.
    bins = max(BINS, int(sorts**0.5) + 1)
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=SEED, maxBins=bins, weightCol="weight").fit(
        dealt.select(array_to_vector("x").alias("features"), "label", "weight")
    )
    judge = Judge(model, {})
    # One row per kind and thousandth of probability.
    steps = known.filter("held").groupBy("kind", F.floor(judge.probability(F.col("x")) * 1000).alias("p")).agg(
        F.sum("weight").alias("n"), F.sum(F.col("label") * F.col("weight")).alias("hits")
    ).collect()
    for kind in KINDS:
        n = hits = 0
        for r in sorted((r for r in steps if r["kind"] == kind), key=lambda r: -r["p"]):
            n, hits = n + r["n"], hits + r["hits"]
            if hits < precision * n:
                break
            judge.cuts[kind] = max(r["p"] / 1000, 0.5)
    return judge


def _listed(spans: Column) -> Column:
    order = {k: i for i, k in enumerate(KINDS)}
    place = F.lit(9)
    keyed = F.transform(spans, lambda s: F.struct(
        _rank(s["kind"], order, place).alias("k"), s["start"].alias("s"), s["end"].alias("e"), s["kind"].alias("kind")
    ))
    return F.array_join(F.transform(F.sort_array(keyed), lambda s: F.concat_ws(":", s["kind"], s["s"].cast("string"), s["e"].cast("string"))), ",")


def _rank(kind: Column, order: dict[str, int], other: Column) -> Column:
    for k, i in order.items():
        other = F.when(kind == k, i).otherwise(other)
    return other


def find_personal_data(docs: DataFrame, judge: Judge | None = None, fit: bool = True) -> DataFrame:
    """``doc_id``, ``base`` and ``added`` spans (kind, start, end) and ``text`` of every row.

    Offsets are code points, the end exclusive. Base spans are the leftmost non-
    overlapping matches of each kind that pass its check. Added spans are
    candidates that the trees accept and that overlap no base span; of added
    spans that overlap each other the earlier, longer one stays.

    Null text is empty and has no spans. Repeated rows give repeated results;
    extra columns are not returned; no rows give no rows. Texts are read whole.
    """
    if judge is None and fit:
        judge = train(docs)
    rows = shield(docs).select("doc_id", text_of().alias("text"))
    based = rows.withColumn("base", F.concat(*[base_spans(F.col("text"), k) for k in KINDS]))
    empty = F.array().cast("array<struct<kind:string,start:int,end:int>>")
    if judge is None or not judge.cuts:
        return based.withColumn("added", empty)
    accepted = F.filter(candidates(F.col("text")), lambda c: judge.accepts(c))
    chosen = let(without_overlap(accepted, F.col("base")), _first_of_each)
    return based.withColumn("added", F.when(F.col("text").rlike(r"[0-9@]|[(\[]at[)\]]"), chosen).otherwise(empty))


def _first_of_each(spans: Column) -> Column:
    """(kind, start, end) of spans left after taking, from the left, each one that meets none taken before; longest first on ties.

    A span begins a cluster where all before it have ended; choices are made inside clusters.
    """
    ordered = F.sort_array(F.transform(spans, lambda c: F.struct(
        c["start"].alias("start"), (-c["end"]).alias("back"), c["kind"].alias("kind"), c["end"].alias("end"))))

    def take(state: Column, c: Column) -> Column:
        span = F.array(F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end")))
        fits = c["start"] >= state["at"]
        return F.struct(F.when(fits, c["end"]).otherwise(state["at"]).alias("at"), F.when(fits, F.concat(state["spans"], span)).otherwise(state["spans"]).alias("spans"))

    empty = F.array().cast("array<struct<kind:string,start:int,end:int>>")
    greedy = lambda part: F.aggregate(part, F.struct(F.lit(0).alias("at"), empty.alias("spans")), take, lambda s: s["spans"])

    def clusters(o: Column) -> Column:
        reach = scan_before(F.transform(o, lambda c: c["end"]), F.greatest, 0)
        heads = let(reach, lambda r: F.filter(F.transform(o, lambda c, i: F.when(c["start"] >= F.get(r, i), i)), lambda i: i.isNotNull()))
        return let(heads, lambda h: F.flatten(F.transform(
            h, lambda i, k: greedy(F.slice(o, i + 1, F.coalesce(F.get(h, k + 1), F.size(o)) - i))
        )))

    return let(ordered, clusters)


def redact(found: DataFrame, mark: str = "[{}]") -> DataFrame:
    """``doc_id`` and ``text`` with every span replaced by its kind; of overlapping spans the outermost start wins."""
    spans = F.sort_array(F.transform(F.concat("base", "added"), lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["kind"].alias("kind"))))

    def step(state: Column, s: Column) -> Column:
        end, inside = -s["back"], s["start"] < state["at"]
        kept = F.substring(F.col("text"), state["at"] + 1, F.greatest(s["start"] - state["at"], F.lit(0)))
        word = F.concat(F.lit(mark.split("{}")[0]), s["kind"], F.lit(mark.split("{}")[1]))
        return F.struct(
            F.greatest(state["at"], end).alias("at"),
            F.when(inside, state["out"]).otherwise(F.concat(state["out"], kept, word)).alias("out"),
        )

    whole = F.aggregate(
        spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step,
        lambda s: F.concat(s["out"], F.substring(F.col("text"), s["at"] + 1, F.length("text"))),
    )
    return found.select("doc_id", whole.alias("text"))


def personal_data_digests(docs: DataFrame) -> DataFrame:
    found = find_personal_data(docs)
    of = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select(
        "doc_id", *[of(k) for k in KINDS], F.sha2(_listed(F.col("base")), 256).alias("base_sha256"),
        _listed(F.concat("base", "added")).alias("spans"), F.size("added").cast("long").alias("n_added"),
    )
