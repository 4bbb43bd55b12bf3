"""Secret scans: candidate strings, judged by a random forest that removes false positives.

Candidates are strings that could be credentials: values assigned to names that hold a credential-like word, strings with a
provider's prefix, private-key blocks (PGP's too), passwords in URLs, and runs of 20 or more key characters that hold a
digit and stand free or behind a sign such as ``=``, whatever the name before it. A candidate
ends where its run or block ends, whatever its length. Each is described by
its length, its character transitions (mean log probability of its letter pairs in dictionary words, share of changes
between kinds of characters), entropy, dictionary coverage, its path (test and example paths), and neighbouring words
that announce a credential or an example. The dictionary holds the words that stand in most documents of the corpus
(``dictionary``: counted over all documents, the ``WORDS`` most frequent) and a few frequent English ones. The forest is
trained from labelled findings: those given, or ``labelled_findings``, a generated set of real-looking secrets and of what
scanners take for them (hashes of files, UUIDs, placeholders, long words, card numbers, encoded data). Lengths of both
kinds come from the same range, so that a length alone tells nothing.

Null and empty texts have no candidates. Repeated rows are scanned each. Offsets are code points, ends exclusive.
``redacted`` replaces found secrets.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from collections.abc import Iterable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bookpulse.llm import forest
from bookpulse.llm.common import discard, map_text, materialize, sealed

THRESHOLD = 0.5
#: Labelled findings used to fit, at most (the generated set is smaller).
FINDINGS = 20_000
#: Words of the dictionary, at most, and documents that each has to stand in.
WORDS, WORD_ROWS = 20_000, 3
MARK = "<SECRET>"

# Prefixes of providers' keys, names of credentials, words that announce secrets or examples.
_PREFIX = r"AKIA[0-9A-Z]{16,}|ASIA[0-9A-Z]{16,}|gh[pousr]_[A-Za-z0-9]{30,}|github_pat_[A-Za-z0-9_]{22,}|glpat-[A-Za-z0-9_-]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_(?:live|test)_[A-Za-z0-9]{16,}|sk-[A-Za-z0-9_-]{20,}|AIza[0-9A-Za-z_-]{30,}|eyJ[A-Za-z0-9_-]{8,}(?:\.[A-Za-z0-9_-]{8,}){2,}|npm_[A-Za-z0-9]{30,}|hf_[A-Za-z0-9]{30,}|SG\.[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{16,}"
_NAME = r"(?:api[_-]?key|apikey|access[_-]?key|secret[_-]?key|client[_-]?secret|secret|token|auth[_-]?token|password|passwd|pwd|passphrase|(?<![a-z])pass(?![a-z])|private[_-]?key|credentials?)"
# A credential's name may go on behind its word. Nothing bounds a candidate from above: it ends where its run ends.
_ASSIGNED = rf"{_NAME}[A-Za-z0-9_-]{{0,64}}+[\"']?\s{{0,3}}(?:=>|:=|=|:)\s{{0,3}}[\"']?(?P<value>[^\s\"'<>,;]{{6,}}+)"
_URL = r"[A-Za-z][A-Za-z0-9+.-]{0,30}://[^\s/:@\"'<>]{0,256}+:(?P<login>[^\s/@\"'<>]{3,}+)@"
_LABEL = r"[A-Z ]*PRIVATE KEY(?: BLOCK)?-----"
_FREE = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{20,}+={0,2}(?![A-Za-z0-9+/_=-])"
_CANDIDATE = re.compile(rf"(?P<block>-----BEGIN {_LABEL})|(?<![A-Za-z0-9+.-]){_URL}|(?i:{_ASSIGNED})|(?<![A-Za-z0-9])(?P<prefix>{_PREFIX})|(?P<free>{_FREE})")
_EDGE = re.compile(rf"-----(?P<edge>BEGIN|END) {_LABEL}")
_ANNOUNCE = re.compile(rf"{_NAME}|\bkey\b|\bauth|bearer|login|credential", re.I)
_EXAMPLE = re.compile(r"example|sample|dummy|placeholder|changeme|your[_-]|xxxx|test|fake|redacted|todo|lorem|<|\$\{|%\(", re.I)
_HASHLIKE = re.compile(r"sha-?\d*|md5|checksum|digest|commit|integrity|etag|uuid|guid|hash|revision", re.I)
_ENCODED = re.compile(r"base64|data:|encoded|blob|image", re.I)
_SET = re.compile(r"[A-Za-z0-9_\]]\s{0,3}(?:=>|:=|=)\s{0,3}[\"']?\Z")
_UUID = re.compile(r"[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}\Z", re.I)
_TEST_PATH = re.compile(r"test|example|sample|fixture|mock|doc", re.I)
_PIECES = re.compile(r"[A-Za-z]{3,}")
# Cheap signs without which a text holds no candidate.
_SIGN = re.compile(rf"-----BEGIN|{_PREFIX}|(?i:{_NAME})[A-Za-z0-9_-]{{0,64}}+[\"']?\s{{0,3}}[=:]|://[^\s/@]*@|[A-Za-z0-9+/_-]{{20}}")

# Frequent words, from which letter pairs and dictionary coverage are judged.
_COMMON = (
    "the of and to in is that for it was on are as with his they at be this from have or by one had not but what all were when we there can an your which their said if do will each about how "
    "up out them then she many some so these would other into has more her two like him see time could no make than first been its who now people my made over did down only way find use may water "
    "long little very after words called just where most know get through back much before go good new write our used me man too any day same right look think also around another came come work "
    "three must because does part even place well such here take why things help put years different away again off went old number password secret token example changeme default user admin test "
    "key value config server client access private public name data file string null true false return import class function var let const def self path host port license version copyright"
).split()
_ENGLISH = frozenset(w for w in _COMMON if len(w) > 2)


def dictionary(docs: DataFrame, text: str = "text") -> frozenset[str]:
    """The WORDS words of 3 to 24 letters a to z that stand in most documents, WORD_ROWS at least.

    Words are told apart by steps of a scale of counts, eighths of a doubling, then by the alphabet. Documents are counted
    in the JVM, combined before the shuffle, and the counts written. How many words reach each step (a few hundred rows)
    gives the steps that are taken whole and the one that fills up, so the driver never gets more than WORDS of them.
    """
    words = F.array_distinct(F.split(F.lower(text), "[^a-z]+"))
    found = docs.select(F.explode(words).alias("word")).where(F.char_length("word").between(3, 24)).groupBy("word").agg(F.count("*").alias("n"))
    counted = materialize(found.where(F.col("n") >= WORD_ROWS).select("word", F.floor(F.log2("n") * 8).alias("step")))
    held, chosen = 0, counted.limit(0)
    for step, size in sorted(map(tuple, counted.groupBy("step").agg(F.count("*")).collect()), reverse=True):
        if held + size > WORDS:
            chosen = counted.where(F.col("step") > step).unionByName(counted.where(F.col("step") == step).orderBy("word").limit(WORDS - held))
            break
        held += size
        chosen = counted.where(F.col("step") >= step)
    known = frozenset(r[0] for r in chosen.select("word").collect())
    discard(counted)
    return known


class Model(NamedTuple):
    """A forest, the dictionary, and the log probability of letter pairs in its words."""

    forest: forest.Forest
    words: frozenset[str]
    pairs: dict[str, float]


def _pairs(words: Iterable[str]) -> dict[str, float]:
    n = Counter(w[i : i + 2] for w in words for i in range(len(w) - 1))
    total = sum(n.values())
    return {a + b: math.log((n[a + b] + 0.2) / (total + 0.2 * 676)) for a in map(chr, range(97, 123)) for b in map(chr, range(97, 123))}


class Candidate(NamedTuple):
    start: int
    end: int
    kind: str  # block, value, prefix, free, login


def _blocks(text: str) -> dict[int, int]:
    """Start and end of each private-key block of any length; a BEGIN line that meets another one before an END is none."""
    edges = list(_EDGE.finditer(text))
    return {m.start(): n.end() for m, n in zip(edges, edges[1:]) if (m["edge"], n["edge"]) == ("BEGIN", "END") and n.start() - m.end() >= 20}


def candidates(text: str | None) -> list[Candidate]:
    """Non-overlapping candidates from the left."""
    if not text or not _SIGN.search(text):
        return []
    blocks = _blocks(text) if "-----BEGIN" in text else {}
    out, m = [], _CANDIDATE.search(text)
    while m:
        kind = m.lastgroup
        start, end = m.span(kind)
        if kind == "block":
            end = blocks.get(start, 0)
        if end:
            out.append(Candidate(start, end, kind))
        m = _CANDIDATE.search(text, end or start + 1)
    return out


def _kind(c: str) -> int:
    return 0 if c.isdigit() else 1 if c.islower() else 2 if c.isupper() else 3


FEATURES = ["length", "pair_score", "changes", "entropy", "digits", "upper", "dictionary", "hex", "kind_block", "kind_value", "kind_prefix", "kind_login", "announced", "example", "hashlike", "encoded", "set", "uuid", "test_path", "distinct"]


def features(text: str, c: Candidate, path: str | None, known: frozenset[str], pairs: dict[str, float]) -> list[float]:
    value = text[c.start : c.end]
    n, low = len(value), value.lower()
    scored = [pairs[p] for p in (low[i : i + 2] for i in range(n - 1)) if p in pairs]
    kinds = [_kind(x) for x in value]
    counts = Counter(value)
    # (longest dictionary word in each piece of a run of letters; long runs are looked at in pieces of 40)
    words = [w[k : k + 40] for w in _PIECES.findall(low) for k in range(0, len(w), 40)]
    covered = sum(max((len(d) for d in (w[i:j] for i in range(len(w)) for j in range(i + 3, min(len(w), i + 24) + 1)) if d in known), default=0) for w in words)
    before = text[max(0, c.start - 60) : c.start]
    around = before + " " + text[c.end : c.end + 40]
    return [
        math.log2(n), sum(scored) / len(scored) if scored else -9.0, sum(a != b for a, b in zip(kinds, kinds[1:])) / max(1, n - 1),
        -sum(k / n * math.log2(k / n) for k in counts.values()), kinds.count(0) / n, kinds.count(2) / n, covered / n,
        float(all(x in "0123456789abcdef" for x in low)), *(float(c.kind == k) for k in ("block", "value", "prefix", "login")),
        float(bool(_ANNOUNCE.search(before))), float(bool(_EXAMPLE.search(around) or _EXAMPLE.search(value, 0, 80))), float(bool(_HASHLIKE.search(before))),
        float(bool(_ENCODED.search(before))), float(bool(_SET.search(before))), float(bool(_UUID.match(value))), float(bool(_TEST_PATH.search(path or ""))), len(counts) / min(n, 64),
    ]


def labelled_findings(n: int = 5000, seed: int = 5) -> list[tuple[str, str, int]]:
    """Generated findings: (text around one candidate, path, 1 for a secret); deterministic.

    Lengths of random strings, in secrets as in hashes of any kind, encoded data and chains of words, are drawn evenly by
    magnitude from 12 to 5,000 characters.
    """
    r = random.Random(seed)
    pick = lambda chars, k: "".join(r.choices(chars, k=k))
    hexa, upper, lower, digit = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
    mixed = upper + lower + digit
    words = [w for w in _COMMON if len(w) > 3]
    syllables = [w[:3] for w in words]
    size = lambda least=12, most=5000: round(least * (most / least) ** r.random())
    prose = lambda k: " ".join(r.choice(_COMMON) for _ in range(k))
    alphabets = [hexa, hexa.upper(), upper + digit, lower + digit, mixed, mixed, mixed + "+/", mixed + "-_"]
    key = lambda least=12, most=5000: pick(r.choice(alphabets), size(least, most)) + r.choice(["", "", "", "=", "=="])
    base = lambda least=20, most=5000: pick(r.choice([mixed, mixed + "+/", mixed + "-_"]), size(least, most)) + r.choice(["", "", "=", "=="])
    names = ["api_key", "token", "password", "secret", "client_secret", "access_key", "auth_token", "passwd", "API_KEY_PROD", "DB_PASS_MAIN", "SECRET_KEY_BASE", "TOKEN_2", "pass"]
    neutral = ["foo", "sig", "STRIPE_HOOK", "code", "x1", "SESSION", "hook", "k", "WEBHOOK", "value", "state", "cookie", "dsn"]
    digests = ["sha256", "sha1", "sha512", "md5", "checksum", "digest", "commit", "etag", "revision", "hash", "integrity", "uuid", "guid"]
    paths, tests = ["src/app.py", "config/prod.yml", "deploy/env", "src0", "web/main.js", "notes"], ["tests/test_auth.py", "docs/example.md", "fixtures/users.json"]
    put = lambda name, v: r.choice(["{n}={v}", "{n} = \"{v}\"", "{n}: {v}", "\"{n}\": \"{v}\"", "{n}='{v}'", "{n}={v}", "{n} {v}"]).format(n=name, v=v)
    given = lambda v: r.choice(["{n}={v}", "?{n}={v}", "&{n}={v}", "export {n}={v}", "{n} = \"{v}\"", "{n}='{v}'"]).format(n=r.choice(neutral), v=v)
    assign = lambda v: r.choice(["{n}={v}", "{n} = \"{v}\"", "{n}: {v}", "\"{n}\": \"{v}\"", "{n}='{v}'"]).format(n=r.choice(names), v=v)
    chain = lambda join, k: join.join(r.choice(words) for _ in range(max(4, k // 6)))
    login = lambda v: f"{r.choice(['postgres', 'mysql', 'https', 'amqp', 'redis', 'mongodb+srv'])}://{r.choice(['app', 'user', 'admin', 'svc'])}:{v}@{r.choice(words)}.{r.choice(words)}{r.choice(['', ':5432', '/db'])}"
    placeholders = ["changeme", "your_api_key_here", "xxxxxxxxxxxxxxxx", "${SECRET_TOKEN}", "<password>", "example-token-value", "os.environ", "placeholder_value", "password", "test1234", "%(password)s", "REDACTED"]
    secrets = [
        lambda: "AKIA" + pick(upper + digit, 16),
        lambda: assign("AKIA" + pick(upper + digit, 16)),
        lambda: assign(pick(hexa, r.choice([16, 18, 20, 24, 32, 40, 64]))),
        lambda: assign(key()), lambda: assign(key()), lambda: assign(key(12, 200)),
        lambda: assign(pick(mixed + "!@#$%^&*", size(10, 64))),
        lambda: r.choice(["ghp_", "gho_"]) + pick(mixed, 36),
        lambda: r.choice(["sk_live_", "sk-", "AIza", "hf_", "npm_", "glpat-"]) + pick(mixed, size(36, 5000)),
        lambda: "xoxb-" + pick(digit, 11) + "-" + pick(mixed, 24),
        lambda: f"eyJ{pick(mixed, size(20, 500))}.eyJ{pick(mixed, size(40, 5000))}.{pick(mixed, 43)}",
        lambda: r.choice(["Authorization: Bearer key ", "bearer key ", "the key ", "login with "]) + base(24), lambda: "Authorization: Bearer " + base(24), lambda: base(24), lambda: base(24),
        lambda: given(base(20)), lambda: given(base(20)), lambda: given("whsec_" + pick(mixed, size(20, 2000))),
        lambda: login(pick(r.choice([mixed, hexa, mixed + "!$%^&*"]), size(8, 2000))), lambda: login(pick(mixed, size(8, 40))),
        lambda: "-----BEGIN RSA PRIVATE KEY-----\n" + "\n".join(pick(mixed + "+/", 64) for _ in range(size(4, 80))) + "\n-----END RSA PRIVATE KEY-----",
    ]
    others = [
        lambda: put(r.choice(digests), pick(hexa, r.choice([32, 40, 56, 64, 96, 128]))), lambda: put(r.choice(digests), pick(hexa, size(20))),
        lambda: put(r.choice(digests), r.choice(["sha256-", "sha512-", ""]) + base(40)),
        lambda: f"{pick(hexa, 8)}-{pick(hexa, 4)}-{pick(hexa, 4)}-{pick(hexa, 4)}-{pick(hexa, 12)}",
        lambda: given(f"{pick(hexa, 8)}-{pick(hexa, 4)}-{pick(hexa, 4)}-{pick(hexa, 4)}-{pick(hexa, 12)}"),
        lambda: assign(r.choice(placeholders)), lambda: login(r.choice(placeholders)), lambda: login(r.choice(words)),
        lambda: assign(f"{r.choice(words)}_{r.choice(words)}"), lambda: assign(chain(r.choice("_-./"), size())),
        lambda: assign(f"get_{r.choice(words)}({r.choice(words)})"),
        lambda: f"the {r.choice(['password', 'token', 'secret'])}: {r.choice(words)}{r.choice(words)}", lambda: f"{r.choice(['tokenizer', 'secretary', 'passage_of', 'tokens_per'])}: {r.choice(words)}{r.choice(words)}",
        lambda: "".join(r.choice(syllables) for _ in range(size(7, 300))) + pick(digit, 1),
        lambda: chain("-", size(20)) + "-" + pick(digit, 4), lambda: given(chain(r.choice("-_/"), size(20)) + pick(digit, 3)),
        lambda: "/".join(r.choice(words) for _ in range(5)) + "/" + pick(digit, 3),
        lambda: pick(digit, size(20, 2000)), lambda: given(pick(digit, size(20, 200))),
        lambda: f"data:{r.choice(['image/png', 'font/woff2', 'image/jpeg'])};base64," + base(40), lambda: r.choice(["encoded blob ", "base64: ", "base64 data=", "image "]) + base(40),
        lambda: "integrity sha512-" + pick(mixed + "+/", 86) + "==",
        lambda: pick(hexa, size(20, 2000)) + "0", lambda: given(pick(hexa, r.choice([32, 40, 64])) + "0"),
        lambda: "example: " + assign("AKIA" + "EXAMPLE" * 2 + "KE"), lambda: "example: " + given("0" + base(20, 200)),
        lambda: "_".join(r.choice(words).upper() for _ in range(size(4, 100))) + "_" + pick(digit, 2),
    ]
    out = []
    while len(out) < n:
        good = r.random() < 0.5
        core = r.choice(secrets if good else others)()
        path = r.choice(paths) if r.random() < (0.9 if good else 0.6) else r.choice(tests)
        out.append((f"{prose(r.randint(2, 9))} {core} {prose(r.randint(2, 9))}", path, int(good)))
    return out


def train(findings: list[tuple[str, str, int]] | None = None, words: frozenset[str] = frozenset()) -> Model:
    """Fit to findings: each text's candidates get its label. At most FINDINGS are used. ``words``: the corpus's dictionary."""
    rows = (findings if findings is not None else labelled_findings())[:FINDINGS]
    known = words | _ENGLISH
    pairs = _pairs(sorted(known))
    x, y = [], []
    for text, path, label in rows:
        for c in candidates(text):
            x.append(features(text, c, path, known, pairs))
            y.append(label)
    return Model(forest.fit(np.array(x), np.array(y)), known, pairs)


class Finding(NamedTuple):
    start: int
    end: int
    kind: str
    score: float


def judge(texts: list, paths: list, model: Model) -> list[list[Finding]]:
    """All candidates of each text with their scores."""
    found = [candidates(t) for t in texts]
    x = np.array([features(t, c, p, model.words, model.pairs) for t, p, cs in zip(texts, paths, found) for c in cs])
    scores = iter(model.forest.scores(x).tolist() if len(x) else [])
    return [[Finding(*c, next(scores)) for c in cs] for cs in found]


def redacted(text: str | None, findings: list[Finding]) -> str | None:
    """The text with each found secret replaced by MARK, in one pass."""
    if not findings:
        return text
    ends = [0, *(f.end for f in findings)]
    starts = [*(f.start for f in findings), len(text)]
    return MARK.join(text[i:j] for i, j in zip(ends, starts))


_FOUND = T.ArrayType(T.StructType([T.StructField("start", T.LongType(), False), T.StructField("end", T.LongType(), False), T.StructField("kind", T.StringType(), False), T.StructField("score", T.DoubleType(), False)]), False)


def scan(docs: DataFrame, model: Model, text: str = "text", path: str | None = "source", threshold: float = THRESHOLD) -> DataFrame:
    """Add secret_candidates and secrets (arrays of start, end, kind, score), redacted (text); other columns pass through."""
    kind = pa.list_(pa.struct([pa.field("start", pa.int64(), False), pa.field("end", pa.int64(), False), pa.field("kind", pa.string(), False), pa.field("score", pa.float64(), False)]))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by trees, depth and WORDS
    plain, name, _ = sealed(docs)
    both = plain.withColumn("scanned", F.struct(F.col(name[text]).alias("text"), (F.col(name[path]) if path else F.lit(None)).cast("string").alias("path")))

    def make():
        m = shared.value

        def f(rows: pa.StructArray) -> list:
            texts, paths = rows.field("text").to_pylist(), rows.field("path").to_pylist()
            found = judge(texts, paths, m)
            kept = [[x for x in xs if x.score >= threshold] for xs in found]
            return [pa.array([[x._asdict() for x in xs] for xs in found], kind), pa.array([[x._asdict() for x in xs] for xs in kept], kind), pa.array([redacted(t, xs) for t, xs in zip(texts, kept)], pa.string())]

        return f

    new = T.StructType([T.StructField("secret_candidates", _FOUND, False), T.StructField("secrets", _FOUND, False), T.StructField("redacted", T.StringType())])
    found = map_text(both, "scanned", new, make, raw=True)
    return found.select(*(F.col(n).alias(c) for c, n in name.items() if c.lower() not in new.fieldNames()), *new.fieldNames())
