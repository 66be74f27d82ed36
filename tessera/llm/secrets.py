"""Operator 6, secret scans: candidates by pattern, false positives removed by a random forest, in DataFrame functions.

Candidates are wide, and the forest decides: what is assigned to a name with a secret word in it, of 6 characters or
more, quoted or up to white space, whatever its characters; tokens of dotted parts, whole; and runs of letters, digits
and ``+ / _ -`` of 12 characters or more with a letter. Features are the candidate's length, shares and changes of
character classes, how often its letters follow each other as in words and how often one class of characters turns into
another, the share of it that a dictionary covers, whether it stands in a path or an address, and the words around it. The forest is Spark ML's, trained on labelled findings;
its trees then become one CASE expression each, so that whole texts are scanned in one pass without a shuffle.

``labelled_findings`` makes a bounded set of findings (``LABELLED`` rows) from templates with pseudo-random values:
keys, tokens and passwords as they leak, and hashes, ids, paths, placeholders and names that look alike.

Edge cases: a null text stays null and has no findings; U+0001 counts as a space, and becomes one in a text that is
redacted; other columns are kept whatever their names; repeated rows are each scanned; a text may be of any length;
an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let

#: Findings that the forest is trained on; trees; depth; seed; share of trees that must agree, in percent.
LABELLED, TREES, DEPTH, SEED, VOTES_PERCENT = 6000, 15, 6, 5, 50
#: Characters around a candidate that count as its neighbourhood.
NEAR = 48
REDACTED = "[SECRET]"

#: Words that stand before secrets, words that stand before other codes, prefixes of known keys.
SECRET_WORDS = "password passwd passphrase pass pwd secret token apikey api_key api-key access_key access-key auth authorization credential credentials bearer private_key client_secret signature key".split()
OTHER_CODES = "commit sha sha1 sha256 md5 checksum digest hash uuid guid build revision version etag order invoice tracking image file id ref issue ticket isbn serial part trace request session".split()
KEY_PREFIXES = "AKIA ASIA ghp_ gho_ glpat- npm_ sk- sk_live_ rk_live_ xoxb- xoxp- AIza eyJ".split()
#: The dictionary whose words a candidate may be made of.
DICTIONARY = (
    "the and for you that with this from have not are was all can one new get set add end use how test example sample demo dummy changeme placeholder default "
    "user admin guest root name page index home main list item view edit post news blog image photo video file data info json html http https www com net org "
    "version release build final draft report table figure chapter section part class type size large small medium left right first last start stop open close "
    "date time year month week day january february march april may june july august september october november december "
    "button color style header footer content article product order number code value string model series summer winter world health company"
).split()


#: Pairs of letters that follow each other in the dictionary's words.
WORD_PAIRS = sorted({w[i : i + 2] for w in DICTIONARY if w.isalpha() for i in range(len(w) - 1)})
#: Transitions that are counted: from a character of one class to one of another.
TRANSITIONS = {"lower_upper": ("a-z", "A-Z"), "letter_digit": ("A-Za-z", "0-9"), "digit_letter": ("0-9", "A-Za-z")}


def _either(words: list[str]) -> str:
    return "|".join(re.escape(w) for w in sorted(words, key=len, reverse=True))


#: What candidates look like (Java patterns). Behind ``ASSIGNED`` stands a
#: value in quotes, or one up to white space, less the punctuation of the sentence around it. Where a value in quotes
#: has white space and holds runs or assignments, or a value is an address, those within are candidates instead.
_INNER = rf"(?![^\s\"']*?(?:://|(?i:{_either(SECRET_WORDS)})[0-9_]{{0,4}}[=:][^\s\"']{{6}}))"
_BARE = rf"{_INNER}(?:(?![.,;:)\]}}]{{0,8}}+(?:[\s\"'<>]|\z)|[&,;][A-Za-z_]\w*+[=:]|\\[\"'n])[^\s\"'<>]){{6,}}+"
ASSIGNED = (
    r"(?<!\.)(?=[A-Za-z0-9+/_.-]{3,}+[\\\"'\]]{0,3}\s{0,8}[=:])([A-Za-z0-9+/_.-]*?"
    rf"(?i:{_either(SECRET_WORDS)})[0-9_]{{0,4}}[\\\"'\]]{{0,3}}\s{{0,8}}(?:=>|[=:]{{1,2}})\s{{0,8}}(?:(?i:bearer|basic|token)\s{{1,8}})?)"
)
_DOTTED = r"(?<![.@])(?=[A-Za-z0-9._-]{12})[A-Za-z0-9_-]{2,}+(?:\.[A-Za-z0-9_-]{6,}+)++(?![@/])"
_RUN = r"(?=[0-9+/_-]*+[A-Za-z])[A-Za-z0-9+/_-]{12,}+={0,2}"
_QUOTED = [
    rf"({q})(?=[^{q}\r\n]{{6,}}+{q}){_INNER}(?:(?=[^{q}\s]++{q})|(?![^{q}\r\n]*?(?:[=:]|[A-Za-z0-9+/_-]{{12}})))([^{q}\r\n]++)"
    for q in ('"', "'")
]
CANDIDATE = rf"(?<![A-Za-z0-9+/_-])(?:{ASSIGNED}(?:{_QUOTED[0]}|{_QUOTED[1]}|((?:\\*[\"'])?)({_BARE}))|({_DOTTED}|{_RUN}))"
#: What stands before and within the candidate, by groups of ``CANDIDATE``.
CUT = "$1$2$4$6\x01$3$5$7$8\x01"

FEATURES = ["length", "digits", "upper", "lower", "marks", "changes", "distinct", "hex", "dictionary", "path", "address", "uuid", "prefix", "secret_word", "secret_near", "other_word", "assigned", "other_marks", "spaces", "dots", "vowels", "words", "word_pairs", *TRANSITIONS]
_TREE = re.compile(r"^\s*(?:(If|Else) \(feature (\d+) (<=|>) ([-\d.Ee]+)\)|Predict: ([\d.]+))$")


def features(c: Column, left: Column, right: Column) -> Column:
    """Struct of ``FEATURES`` (doubles) of a candidate between two texts."""
    n = F.length(c)
    before, after = F.lower(F.substring(left, -NEAR, NEAR)), F.substring(right, 1, NEAR)
    share = lambda pattern: F.regexp_count(c, F.lit(pattern)) / n
    classes = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "[A-Z]+", "A"), "[a-z]+", "a"), "[0-9]+", "0"), "[^A-Za-z0-9]+", "-")
    known = n - F.length(F.regexp_replace(F.lower(c), f"(?:{_either(DICTIONARY)})", ""))
    has = lambda text, pattern: text.rlike(pattern).cast("double")
    found = {
        "length": n,
        "digits": share("[0-9]"),
        "upper": share("[A-Z]"),
        "lower": share("[a-z]"),
        "marks": share("[+/_-]"),
        "changes": (F.length(classes) - 1) / n,
        "distinct": F.size(F.array_distinct(F.split(c, ""))) / n,
        "hex": has(c, "^(?:[0-9a-f]+|[0-9A-F]+)$"),
        "dictionary": known / n,
        "path": F.greatest(has(before, r"[/\\.]$"), has(after, r"^[/\\.][A-Za-z0-9]"), F.least(F.lit(1.0), F.regexp_count(c, F.lit("/")) / 2)),
        "address": F.greatest(has(after, "^@"), has(before, r"(?:@|https?://|www\.)\S*$")),
        "uuid": has(c, "^[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$"),
        "prefix": has(c, f"^(?:{_either(KEY_PREFIXES)})"),
        "secret_word": has(before, rf"(?:{_either(SECRET_WORDS)})[0-9_]{{0,4}}[^a-z0-9]{{1,8}}(?:(?:bearer|basic|token)\s+)?$"),
        "secret_near": has(before, rf"(?:{_either(SECRET_WORDS)})"),
        "other_word": has(before, rf"\b(?:{_either(OTHER_CODES)})[^a-z0-9]{{1,8}}$"),
        "assigned": has(before, r"""[=:]\s*["']?$"""),
        "other_marks": share(r"[^A-Za-z0-9+/_=\s.-]"),
        "spaces": share(r"\s"),
        "dots": share(r"\."),
        "vowels": share("[aeiouAEIOU]"),
        "words": has(c, r"^(?:[a-z]+|[A-Z]+|[A-Z]?[a-z]+(?:[A-Z][a-z]+)*+|[A-Z]?[a-z]+(?:[-_/. ]+[A-Z]?[a-z]+)*+|[A-Z]+(?:[-_/.]+[A-Z]+)*+)$"),
    }
    next_to = lambda pattern: F.regexp_count(c, F.lit(pattern)) / F.greatest(n - 1, F.lit(1))
    firsts = sorted({x[0] for x in WORD_PAIRS})
    found["word_pairs"] = next_to("(?i)(?=" + "|".join(f"{a}[{''.join(x[1] for x in WORD_PAIRS if x[0] == a)}]" for a in firsts) + ")")
    found |= {name: next_to(f"(?<=[{a}])(?=[{b}])") for name, (a, b) in TRANSITIONS.items()}
    return F.struct(*(found[name].cast("double").alias(name) for name in FEATURES))


def cut_text(text: Column) -> Column:
    """The text in pieces; those at odd places are its candidates."""
    return F.split(F.regexp_replace(F.replace(text, F.lit("\x01"), F.lit(" ")), CANDIDATE, CUT), "\x01")


def around(p: Column, i: Column) -> tuple[Column, Column]:
    """What stands before and behind piece ``i``, other candidates included: the neighbourhood is not cut at them."""
    piece = lambda k: F.coalesce(F.get(p, i + k), F.lit(""))
    near = lambda k: F.substring(piece(k), -NEAR, NEAR) if k < 0 else F.substring(piece(k), 1, NEAR)
    return F.concat(*(near(k) for k in range(-5, 0))), F.concat(*(near(k) for k in range(1, 6)))


def labelled_findings(spark: SparkSession, rows: int = LABELLED, seed: int = SEED) -> DataFrame:
    """(id, text, label, secret): short texts; label 1.0 and the secret if there is one. As many of either kind.

    One nested expression, which Spark interprets: as generated code all templates together would be too large.
    """
    ids = spark.range(0, rows, 1, 1)
    return ids.select("id", let(F.col("id"), lambda i: _finding(i, seed)).alias("x")).select("id", "x.text", "x.label", "x.secret")


def _finding(i: Column, seed: int) -> Column:
    """Struct (text, label, secret) of one labelled finding."""
    r = lambda salt: F.sha2(F.concat_ws(":", F.lit(seed), F.lit(salt), i), 256)  # noqa: E731  64 hex digits
    n = lambda salt, below: F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), i), F.lit(below)).cast("int")
    pick = lambda salt, words: F.element_at(F.split(F.lit("\x02".join(words)), "\x02"), n(salt, len(words)) + 1)
    base64 = lambda salt: F.translate(F.base64(F.unhex(r(salt))), "=", "")  # noqa: E731  43 characters
    plain = lambda salt: F.translate(base64(salt), "+/", "xQ")
    upper32 = lambda salt: F.translate(F.upper(F.substring(r(salt), 1, 32)), "01", "QZ")
    syllables = "the on ra ti en lo ur che mento ly ed ing au sch pa do re vi".split()
    word = lambda salt: F.concat(*(pick(f"{salt}{k}", syllables) for k in range(3)))
    words = lambda salt: F.concat_ws(" ", *(word(f"{salt}w{k}") for k in range(3)))
    secret_word = pick("sw", ["password", "passwd", "pwd", "secret", "token", "api_key", "apikey", "access_key", "auth_token", "client_secret", "private_key", "PASSWORD", "API_KEY", "SECRET_KEY", "Token"])
    sign = pick("sign", ["=", ": ", " = ", ' = "', '="', ": '", "='"])
    ends = pick("end", ['"', "'", " ", "\n", ",", ";"])
    safe = lambda c: F.concat(F.lit("a"), c, F.lit("7"))  # noqa: E731  a letter and a digit, whatever the rest
    none = F.lit("")
    letters = lambda salt: F.translate(plain(salt), "0123456789", "kRwZmTqLxG")
    odd = lambda salt: pick(salt, list("@!#$%&*?^~"))
    part = lambda salt, least, more: F.substring(F.translate(base64(salt), "+/", "-_"), 1, F.lit(least) + n(f"{salt}l", more))
    quoted = pick("quoted", [' = "', '="', ': "'])
    # what stands before the secret, the secret, what stands behind
    secrets = [
        (F.concat(secret_word, sign), F.substring(r("a"), 1, 16 + n("al", 4) * 2), ends),
        (F.concat(secret_word, sign), F.substring(r("b"), 1, 40), ends),
        (F.concat(secret_word, sign), F.substring(safe(plain("c")), 1, 14 + n("cl", 30)), ends),
        (F.concat(secret_word, sign), safe(base64("d")), ends),
        (pick("e", ["", "key ", "aws ", 'id = "', "access_key_id: "]), F.concat(F.lit("AKIA"), F.substring(upper32("e1"), 1, 16)), ends),
        (pick("e2", ["", "key ", "aws ", 'id = "', "access_key_id: "]), F.concat(pick("e3", ["AKIA", "ASIA"]), F.translate(F.substring(upper32("e4"), 1, 16), "23456789", "GHKMNPRT")), ends),
        (pick("f", ["", "token ", 'export X="', "use "]), F.concat(pick("fp", ["ghp_", "gho_", "glpat-", "npm_", "sk-", "sk_live_", "xoxb-", "AIza"]), F.substring(safe(plain("f1")), 1, 30), F.lit("7")), ends),
        (pick("f2", ["", "token ", 'export X="', "use "]), F.concat(pick("fq", ["ghp_", "gho_", "glpat-", "npm_", "sk_live_", "AIza"]), F.substring(letters("f3"), 1, 30)), ends),
        (F.lit("Authorization: Bearer "), F.concat(F.lit("eyJ"), plain("g"), F.lit("0")), ends),
        (pick("g1", ["Authorization: Bearer ", "", "token=", 'jwt = "', "use "]), F.concat(F.lit("eyJ"), part("g2", 17, 20), F.lit("."), F.lit("eyJ"), part("g3", 12, 28), F.lit("."), part("g4", 30, 12)), ends),
        (F.concat(secret_word, F.lit(" is ")), F.concat(F.substring(safe(plain("h")), 1, 20), F.lit("9")), F.concat(F.lit(" "), word("h2"))),
        (F.concat(secret_word, sign), F.concat(F.when(n("u0", 3) == 0, F.initcap(word("u"))).otherwise(word("u")), n("u1", 999).cast("string"), pick("u2", ["abc", "xy", "q", "Zz", ""])), ends),
        (F.concat(secret_word, sign), F.concat(F.substring(word("z"), 1, 5 + n("z0", 4)), n("z1", 99).cast("string"), F.substring(letters("z2"), 1, n("z3", 4))), ends),
        (F.concat(secret_word, sign), F.concat(pick("v", ["Tr", "hu", "mo", "Be", "xK", "Su"]), n("v1", 99).cast("string"), F.substring(word("v2"), 1, 3), odd("v3"), n("v4", 9999).cast("string"), pick("v5", ["", "!", "#"])), ends),
        (F.concat(secret_word, sign), F.concat(F.substring(letters("w"), 1, 4 + n("w1", 8)), odd("w2"), F.substring(letters("w3"), 1, 3)), ends),
        (F.concat(secret_word, sign), F.substring(letters("x"), 1, 12 + n("x1", 20)), ends),
        (F.concat(secret_word, quoted), F.concat(F.initcap(word("y")), F.lit(" "), n("y1", 999).cast("string"), odd("y2"), F.lit(" "), word("y3"), odd("y4")), F.lit('"')),
    ]
    others = [
        F.concat(pick("i", ["commit ", "sha1: ", "revision ", "md5 = ", "checksum: ", "etag: ", "sha256=", "build ", "hash "]), F.substring(r("i1"), 1, F.element_at(F.array(F.lit(40), F.lit(32), F.lit(64), F.lit(16)), n("il", 4) + 1)), ends),
        F.concat(pick("j", ["", "id ", "uuid: ", "request ", "trace=", "session ", "token type "]), F.regexp_replace(F.substring(r("j1"), 1, 32), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), ends),
        F.concat(F.lit("https://www."), word("k"), F.lit(".com/"), word("k2"), F.lit("/"), F.substring(r("k1"), 1, 14 + n("kl", 20)), pick("ke", [".jpg", ".html", "/", "?x=1"]), ends),
        F.concat(word("l"), F.lit("/"), word("l1"), F.lit("/"), F.substring(r("l2"), 1, 20), F.lit(".png "), word("l3")),
        F.concat(pick("m", ["report", "release", "summer", "product", "image", "version", "chapter"]), F.lit("-"), pick("m1", ["final", "draft", "table", "large", "index"]), F.lit("-2"), n("m2", 999).cast("string"), F.lit("-"), pick("m3", ["user", "data", "view"]), ends),
        F.concat(secret_word, sign, pick("o", ["changeme", "example", "placeholder", "your_password", "test-password", "default_value", "dummy-token"]), pick("o1", ["_123456", "12345", "-2024-here", "000000000"]), ends),
        F.concat(secret_word, sign, F.repeat(pick("p", ["x", "X", "0a", "ab1", "1x"]), 12), F.lit("1x"), ends),
        F.concat(word("q"), F.lit("_"), word("q1"), F.lit("_0"), n("q2", 99).cast("string"), F.lit("@mail.example.com "), word("q3")),
        F.concat(word("r"), word("r1"), word("r2"), n("r3", 99).cast("string"), F.lit("a "), word("r4")),
        F.concat(F.lit("20240"), n("s", 9).cast("string"), F.lit("11T0"), n("s1", 99999).cast("string"), F.lit("Z-"), word("s2"), F.lit(" ")),
        F.concat(word("A"), word("A1"), word("A2"), word("A3"), F.lit(" ")),
        F.upper(F.concat(words("J"), F.lit("!! "), word("J1"), word("J2"), word("J3"), pick("J4", [" ", "!! ", ". ", ",!! "]), words("J5"))),
        F.upper(F.concat(words("K"), F.lit(" "), pick("K0", ["th", "sch", "er", "wh"]), word("K1"), pick("K3", ["sch", "th", "st", "ng"]), word("K2"), pick("K4", [" ", "!! ", ". ", ",!! "]), words("K5"))),
        F.concat(F.initcap(word("B")), pick("B1", ["-", "/", "_", "", "."]), F.initcap(word("B2")), pick("B3", ["-", "/", "_", ""]), word("B4"), ends),
        F.concat(F.lower(word("C")), F.initcap(word("C1")), F.initcap(word("C2")), pick("C3", ["(", "=", " ", "."]), F.lit(" ")),
        F.concat(F.upper(word("D")), F.lit("_"), F.upper(word("D1")), F.lit("_"), F.upper(word("D2")), pick("D3", ["=", " ", ": "])),
        F.concat(secret_word, sign, word("E"), pick("E1", ["", ",", "."]), F.lit(" "), word("E2"), ends),
        F.concat(secret_word, quoted, word("F"), F.lit(" "), word("F1"), F.lit(" "), word("F2"), F.lit('"')),
        F.concat(secret_word, sign, pick("G", ["os.environ", "process.env.PASSWORD", "getpass()", "get_token()", "required", "optional", "string", "undefined", "config.secret", "settings.TOKEN", "self.password", "********", "<password>", "${PASSWORD}", "$PASSWORD", "{{ token }}", "%(password)s", "YOUR_API_KEY", "input()"]), ends),
        F.concat(word("H"), F.lit("."), word("H1"), pick("H2", [".example ", ".module ", "() ", " "]), word("H3")),
        F.concat(F.lit("release-"), n("I", 9).cast("string"), F.lit(".example."), word("I1"), F.lit(" ")),
        F.concat(pick("t", ["order ", "invoice ", "tracking ", "ticket ", "isbn ", "serial "]), F.upper(F.substring(r("t1"), 1, 12)), F.lit("A1 "), word("t2")),
    ]
    secrets = [F.struct(a.alias("before"), b.alias("secret"), c.alias("after")) for a, b, c in secrets]
    others = [F.struct(x.alias("before"), F.lit(None).cast("string").alias("secret"), none.alias("after")) for x in others]

    def choose(kinds: list[Column], salt: str) -> Column:
        at, out = n(salt, len(kinds)), kinds[-1]
        for k, kind in reversed(list(enumerate(kinds[:-1]))):
            out = F.when(at == k, kind).otherwise(out)
        return out

    is_secret = n("label", 2) == 1
    body = F.when(is_secret, choose(secrets, "kind")).otherwise(choose(others, "kind2"))
    return let(
        body,
        lambda b: F.struct(
            F.concat(words("left"), F.lit(" "), b["before"], F.coalesce(b["secret"], none), b["after"], F.lit(" "), words("right")).alias("text"),
            is_secret.cast("double").alias("label"),
            b["secret"].alias("secret"),
        ),
    )


def finding_features(findings: DataFrame) -> DataFrame:
    """(id, label, x): features of every candidate of the labelled findings; label 1.0 for those that are the secret."""
    pieces = findings.withColumn("p", cut_text(F.col("text"))).filter(F.size("p") > 1)
    places = pieces.withColumn("i", F.explode(F.sequence(F.lit(1), F.size("p") - 2, F.lit(2))))
    mine = F.coalesce(F.col("p")[F.col("i")].contains(F.col("secret")), F.lit(False)).cast("double")
    return places.select("id", mine.alias("label"), let(F.col("p")[F.col("i")], lambda c: features(c, *around(F.col("p"), F.col("i")))).alias("x"))


def train_forest(findings: DataFrame, trees: int = TREES, depth: int = DEPTH, seed: int = SEED) -> list[list]:
    """Nested lists, one a tree: [feature, threshold, left, right], or a vote 0 or 1."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    findings = findings.select("id", "text", "secret").persist()  # so that templates aren't repeated in every feature
    rows = finding_features(findings).persist()
    try:
        given = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows.select("label", "x.*"))
        forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, maxBins=64).fit(given.select("label", "features"))
    finally:
        rows.unpersist()
        findings.unpersist()
    return [_tree(iter(tree.toDebugString.splitlines()[1:])) for tree in forest.trees]


def _tree(lines) -> list | int:
    """A tree from Spark ML's description of it."""
    kind, feature, _, threshold, vote = _TREE.match(next(lines)).groups()
    if vote is not None:
        return int(float(vote))
    left = _tree(lines)
    next(lines)  # the Else of the same split
    return [int(feature), float(threshold), left, _tree(lines)]


def votes(forest: list[list], x: Column) -> Column:
    """Trees that take the finding with features ``x`` for a secret."""

    def decide(node) -> Column:
        if not isinstance(node, list):
            return F.lit(node)
        feature, threshold, left, right = node
        return F.when(x[FEATURES[feature]] <= threshold, decide(left)).otherwise(decide(right))

    total = F.lit(0)
    for tree in forest:
        total = total + decide(tree)
    return total


def with_votes(text: Column, forest: list[list], body: Callable[[Column, Column], Column]) -> Column:
    """``body(pieces, votes)`` of a text: its pieces, and the votes for each candidate in order.

    One nested expression: whatever the optimizer does with it, a text is cut once for each time it is evaluated.
    """

    def judge(p: Column) -> Column:
        places = F.filter(F.sequence(F.lit(1), F.greatest(F.size(p), F.lit(2)) - 1), lambda i: (i % 2 == 1) & (i < F.size(p)))
        return let(F.transform(places, lambda i: let(features(p[i], *around(p, i)), lambda x: votes(forest, x))), lambda v: body(p, v))

    return let(cut_text(text), judge)


def _least(forest: list[list], votes_percent: int) -> int:
    return len(forest) * votes_percent // 100 + 1


def find_secrets(documents: DataFrame, forest: list[list], votes_percent: int = VOTES_PERCENT) -> DataFrame:
    """doc_id, start, length (code points of the whole text), sha256 (of the secret), votes of each secret found."""
    least = _least(forest, votes_percent)

    def found(p: Column, v: Column) -> Column:
        lengths = F.transform(p, F.length)
        start = lambda place: F.aggregate(F.slice(lengths, 1, place), F.lit(0).cast("bigint"), lambda a, n: a + n)
        every = F.transform(v, lambda n, i: F.struct((i * 2 + 1).alias("place"), n.alias("votes")))
        secret = lambda x: F.get(p, x["place"])
        return F.transform(
            F.filter(every, lambda x: x["votes"] >= least),
            lambda x: F.struct(start(x["place"]).alias("start"), F.length(secret(x)).cast("bigint").alias("length"), F.sha2(secret(x).cast("binary"), 256).alias("sha256"), x["votes"].cast("int").alias("votes")),
        )

    rows = documents.filter("text IS NOT NULL").select("doc_id", F.explode(with_votes(F.col("text"), forest, found)).alias("x"))
    return rows.select("doc_id", "x.start", "x.length", "x.sha256", "x.votes")


def redact(documents: DataFrame, forest: list[list], text: str = "text", votes_percent: int = VOTES_PERCENT) -> DataFrame:
    """``documents`` with every secret in the text replaced by ``REDACTED``; no row is dropped."""
    least = _least(forest, votes_percent)

    def clean(p: Column, v: Column) -> Column:
        piece = lambda x, i: F.when((i % 2 == 1) & (F.get(v, F.floor(i / 2).cast("int")) >= least), F.lit(REDACTED)).otherwise(x)
        return F.when(F.exists(v, lambda n: n >= least), F.array_join(F.transform(p, piece), "")).otherwise(F.col(text))

    return documents.withColumn(text, F.when(F.col(text).isNotNull(), with_votes(F.col(text), forest, clean)))
