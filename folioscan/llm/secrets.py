"""Secret scan with a random forest that removes false positives.

Candidates are runs of key characters with a digit or changing case in them, whatever is assigned to a secret's name,
quoted or up to the next space, and blocks of private keys. Features read the candidate (length, character transitions,
shares of character classes, dictionary coverage), its path and the words on both sides. The forest is trained on
labelled findings; its trees become arrays that a fold walks, so the scan runs on SQL functions alone and the verdict
can be filtered on like any column.
"""

from __future__ import annotations

import json
import random
import string
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscan.functions.text import let, matches

# What counts as a candidate, and the words that tell about it.
KEY_CHARS = r"A-Za-z0-9+/_\-"
#: With a digit; or of known form; or long, with three changes from small to capital letters.
CANDIDATE = rf"(?<![{KEY_CHARS}])(?=[{KEY_CHARS}]{{8}})(?:(?=[A-Za-z+/_\-]*+[0-9])|(?=A[KS]IA[A-Z]{{16}}(?![{KEY_CHARS}]))|(?=[{KEY_CHARS}]{{20}})(?=(?:[{KEY_CHARS}]*?[a-z][A-Z]){{3}}))[{KEY_CHARS}]{{8,}}={{0,2}}"
BLOCK = r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----(?s:.*?)-----END [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----"
PREFIXES = r"^(?:-----BEGIN |AKIA|ASIA|AIza|gh[pousr]_|glpat-|xox[abprs]-|sk-|sk_live_|rk_live_|eyJ|SG|npm_|hf_)"
NAMES = r"(?i)pass(?:word|wd|phrase)?|pwd|secret|token|api.?key|access.?key|credential|auth|private.?key|bearer"
#: The value assigned to a secret's name: all in quotes, else up to a space, without closing marks at its end.
ASSIGNED = r"""(?<=")[^"]+(?=")|(?<=')[^']+(?=')|[^\s"']\S*(?<![,;.)\]}>"'`])"""
BEFORE_ASSIGNED = rf"""(?:{NAMES})[\w.\-]{{0,40}}["'\]]{{0,2}}\s{{0,9}}(?::=|=>|[:=])\s{{0,9}}["']?"""
#: Values that name where the secret comes from, or its kind, and are none themselves.
REFERENCES = r"""(?i)^(?:[$<{(%\[*.]|(?:none|null|nil|true|false|required|optional|string|str|text|undefined|hidden|redacted|changeme|invalid|expired|missing|unknown|empty)\b|[\w.]*[a-z_]\w*[(\[]|(?:os|env|process|config|settings|self|this)\.|https?:)|^(?:\W+|(.)\1+)$"""
DECOYS = r"example|dummy|placeholder|sample|test|fake|commit|sha\d*|checksum|digest|uuid|guid|build|version|https?:|href|src|order|invoice|card|phone|isbn|id"
PATHS = r"(?i)test|example|sample|fixture|mock|docs?(?:/|$)|readme"
UUID = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
DICTIONARY = tuple(
    "the and for with from this that have not you your are was will can all new get set add use user name file path page index item list data type value "
    "config default version release build test example sample dummy placeholder change here image photo video product order invoice number report chapter "
    "section figure table node main home server client host local public private static assets style script module package library http https www com "
    "january february march april june july august september october november december monday tuesday friday password secret token key access".split()
)
#: Characters on each side of a candidate that hold its neighbouring words.
AROUND = 40
TREES, DEPTH, LEAF = 25, 5, 4
#: Probability from which a candidate is a secret.
THRESHOLD = 0.5

FEATURES = ("length", "transitions", "digits", "upper", "symbols", "hexadecimal", "coverage", "distinct", "path", "named", "decoy", "assigned", "prefix", "uuid", "reference", "decoy_after")


def features(value: Column, before: Column, path: Column, after: Column) -> list[Column]:
    """The forest's inputs as DOUBLE columns, in the order of FEATURES."""
    n = F.length(value).cast("double")
    classes = F.translate(value, string.ascii_lowercase + string.ascii_uppercase + string.digits + string.punctuation, "a" * 26 + "A" * 26 + "0" * 10 + "-" * len(string.punctuation))
    share = lambda other: F.length(F.regexp_replace(classes, other, "")) / n
    flag = lambda text, pattern: F.coalesce(F.regexp_like(text, F.lit(pattern)), F.lit(False)).cast("double")
    words = "|".join(sorted(DICTIONARY, key=lambda w: (-len(w), w)))
    return [
        n,
        (F.length(F.regexp_replace(classes, r"(.)\1+", "$1")) - 1) / n,
        share("[^0]"),
        share("[^A]"),
        share("[^-]"),
        flag(value, r"^(?:[0-9a-f]+|[0-9A-F]+)$"),
        1 - F.length(F.regexp_replace(F.lower(value), words, "")) / n,
        F.size(F.array_distinct(F.split(value, ""))) / n,
        flag(path, PATHS),
        flag(before, rf"(?:{NAMES})[^\n]{{0,14}}$"),
        flag(before, rf"(?i)(?<![\w@.])(?:{DECOYS})(?![\w.])[^\n]{{0,14}}$"),
        flag(before, r"[=:]\s*[\"']?$"),
        flag(value, PREFIXES),
        flag(value, UUID),
        flag(value, REFERENCES),
        flag(after, rf"(?i)^[^\n\w]{{0,6}}(?:is |as |for |in )?(?:an? |the )?(?:{DECOYS})(?!\w)"),
    ]


def labelled_findings(count: int = 1200, seed: int = 11) -> list[tuple[str, str, str, str, int]]:
    """Made findings (value, before, path, after, label), half of them secrets; the same ones on every call."""
    r = random.Random(seed)
    pick = lambda chars, n: "".join(r.choice(chars) for _ in range(n))
    low, any_, hexa = string.ascii_lowercase, string.ascii_letters + string.digits, "0123456789abcdef"
    word = lambda: r.choice(DICTIONARY)
    prose = lambda: " ".join(pick(low, r.randint(2, 8)) for _ in range(4)) + " "
    case = lambda s: s.upper() if r.random() < 0.15 and "PRIVATE" not in s else s
    camel = lambda: "".join(w.capitalize() for w in r.sample(DICTIONARY, r.randint(4, 6)))
    told = lambda: r.choice([" (example only)", " is a dummy", " for test", ", sample", " - placeholder"])
    tail = lambda: r.choice(["", "", " " + prose(), "'", '", ', ";"])
    made = []
    for k in range(count):
        name = r.choice(["password", "passwd", "secret", "token", "api_key", "API-KEY", "access_key", "client_secret", "auth_token", "pwd"])
        mark = r.choice(["=", " = ", ": ", ":", ' = "', "='", '="'])
        if k % 2:
            value = r.choice([
                lambda: pick(hexa, r.choice([16, 18, 20, 24, 32, 40, 64])), lambda: pick(any_, r.randint(16, 48)), lambda: "AKIA" + pick(string.ascii_uppercase + string.digits, 16),
                lambda: "ghp_" + pick(any_, 36), lambda: "sk-" + pick(any_, r.randint(24, 48)), lambda: "eyJ" + pick(any_ + "_-", r.randint(20, 60)), lambda: pick(any_ + "+/", 43) + "=",
                lambda: pick(low, r.randint(4, 8)) + pick(string.digits, r.randint(2, 5)) + pick(any_, r.randint(2, 6)), lambda: "xoxb-" + pick(string.digits, 11) + "-" + pick(any_, 24),
                lambda: pick(string.ascii_letters, r.randint(24, 48)), lambda: "AKIA" + pick(string.ascii_uppercase, 16),
                lambda: "-----BEGIN RSA PRIVATE KEY-----\n" + "\n".join(pick(any_ + "+/", 64) for _ in range(r.randint(2, 9))) + "\n-----END RSA PRIVATE KEY-----",
            ])()
            known = value.startswith(("AKIA", "ghp_", "sk-", "xoxb", "eyJ", "-----"))
            before = prose() + ("" if known and r.random() < 0.4 else name + mark)
            path, after = r.choice(["", "src0", "src/app.py", "config/prod.env", "src12"]), tail()
        else:
            value, before, *rest = r.choice([
                lambda: (pick(hexa, r.choice([32, 40, 64])), prose() + r.choice(["commit ", "sha256: ", "checksum=", "digest ", "build ", "md5 "])),
                lambda: (str(uuid.UUID(int=r.getrandbits(128))), prose() + r.choice(["", "id: ", "uuid=", "guid "])),
                lambda: (pick(string.digits, r.choice([8, 10, 13, 16])), prose() + r.choice(["", "order ", "card ", "phone: ", "invoice="])),
                lambda: (f"{word()}-{word()}-{r.randint(1, 2030)}-{word()}", prose() + r.choice(["", "https://", 'href="', name + mark])),
                lambda: (f"{word()}_{word()}_{r.randint(1, 99)}", prose() + r.choice(["", name + mark])),
                lambda: (f"{word()}/{word()}/{pick(low, 5)}{r.randint(1, 999)}/{word()}", prose() + r.choice(["", "src=", "https://"])),
                lambda: (f"{r.randint(1990, 2030)}-0{r.randint(1, 9)}-{r.randint(10, 28)}T{r.randint(10, 23)}", prose()),
                lambda: (r.choice(["your", "example", "dummy", "changeme", "placeholder", "test"]) + r.choice(["", "-", "_"]) + r.choice(["password", "token", "key", "secret"]) + str(r.randint(1, 999)), prose() + name + mark),
                lambda: (pick(low, r.randint(7, 16)) + r.choice(["1", "2", "10"]), prose()),
                lambda: (pick(any_, r.randint(16, 32)), prose() + r.choice(["example token ", "dummy key: ", "sample secret=", "placeholder "])),
                lambda: (pick(any_, r.randint(16, 32)), prose() + name + mark, told()), lambda: (pick(any_, r.randint(8, 20)), prose() + name + mark, told()),
                lambda: (pick(hexa, r.choice([16, 20, 32, 40])), prose() + r.choice(["", name + mark]), told()), lambda: (camel(), prose()), lambda: (camel()[0].lower() + camel()[1:], prose() + r.choice(["", name + mark])),
            ])()
            path = r.choice(["", "src0", "tests/fixtures/keys.py", "docs/example.md", "src3", "README"])
            after = rest[0] if rest else tail()
        made.append((case(value), before[-AROUND:], path, after[:AROUND], k % 2))
    marks = "!@#$%^&*.?~"
    for k in range(count // 2):  # values that only their name makes candidates
        name = r.choice(["password", "passwd", "secret", "token", "api_key", "db_password", "passphrase", "client_secret", "auth_token", "pwd"])
        mark = r.choice(["=", " = ", ": ", ":", ' = "', "='", '="'])
        if k % 2:
            value = r.choice([
                lambda: "".join(pick(low, r.randint(4, 8)) for _ in range(r.randint(3, 4))), lambda: pick(string.ascii_letters, r.randint(12, 40)),
                lambda: pick(string.ascii_uppercase, 1) + pick(low, r.randint(0, 3)) + pick(marks, 1) + pick(any_, r.randint(3, 9)) + pick(marks, 1) + pick(string.digits, r.randint(1, 4)),
                lambda: pick(any_ + marks, r.randint(9, 24)), lambda: " ".join(pick(low, r.randint(4, 8)) for _ in range(4)),
            ])()
            path = r.choice(["", "src0", "src/app.py", "config/prod.env", "src12"])
        else:
            value = r.choice([
                lambda: pick(low, r.randint(1, 9)), lambda: word(), lambda: pick(string.digits, r.randint(1, 4)), lambda: "${" + pick(string.ascii_uppercase, r.randint(4, 12)) + "}",
                lambda: f"os.environ[{word()}", lambda: f"get_{word()}(self", lambda: f"<your-{word()}>", lambda: r.choice(["required", "optional", "string", "none", "null", "true", "changeme", "undefined"]),
                lambda: pick(string.ascii_uppercase, 1) + pick(low, r.randint(1, 8)), lambda: "*" * r.randint(3, 16), lambda: f"{word()}-{word()}-{word()}",
            ])()
            path = r.choice(["", "src0", "docs/example.md", "src3", "README"])
        made.append((value, (prose() + name + mark)[-AROUND:], path, tail()[:AROUND], k % 2))
    return made


def _tree(x: np.ndarray, y: np.ndarray, depth: int, rng: np.random.Generator):
    """A leaf's share of label 1, or (feature, threshold, tree of values up to it, tree of the others)."""
    if depth == 0 or len(y) < 2 * LEAF or y.min() == y.max():
        return float(y.mean())
    best = (len(y) * y.mean() * (1 - y.mean()) - 1e-9, None)
    for j in rng.choice(x.shape[1], size=int(np.ceil(np.sqrt(x.shape[1]))) + 1, replace=False):
        order = np.argsort(x[:, j], kind="stable")
        v, ones = x[order, j], np.cumsum(y[order])
        k = np.arange(1, len(y))
        left, right = ones[:-1] / k, (ones[-1] - ones[:-1]) / (len(y) - k)
        loss = k * left * (1 - left) + (len(y) - k) * right * (1 - right)
        loss[(v[:-1] == v[1:]) | (k < LEAF) | (len(y) - k < LEAF)] = np.inf
        at = int(loss.argmin())
        if loss[at] < best[0]:
            best = (loss[at], (int(j), float((v[at] + v[at + 1]) / 2)))
    if best[1] is None:
        return float(y.mean())
    j, cut = best[1]
    low = x[:, j] <= cut
    return j, cut, _tree(x[low], y[low], depth - 1, rng), _tree(x[~low], y[~low], depth - 1, rng)


def grow(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, seed: int = 5) -> list:
    """A forest of bootstrapped trees."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(trees):
        rows = rng.integers(0, len(y), len(y))
        out.append(_tree(x[rows], y[rows], depth, rng))
    return out


def as_column(forest: list, inputs: list[Column]) -> Column:
    """The forest's probability: all trees' nodes lie in arrays, and every tree is walked from its root by a fold."""
    nodes: list[tuple] = []

    def lay(tree) -> int:
        at = len(nodes)
        nodes.append(())
        if isinstance(tree, float):
            nodes[at] = (-1, 0.0, at, at, tree)
        else:
            j, cut, low, high = tree
            nodes[at] = (j, cut, lay(low), lay(high), 0.0)
        return at

    def depth(tree) -> int:
        return 0 if isinstance(tree, float) else 1 + max(depth(tree[2]), depth(tree[3]))

    roots, deepest = [lay(t) for t in forest], max(map(depth, forest))
    rows = json.dumps([dict(zip(("j", "cut", "low", "high", "value"), n, strict=True)) for n in nodes])
    table = F.from_json(F.lit(rows), "array<struct<j:int,cut:double,low:int,high:int,value:double>>")  # folded once
    steps = F.array(*[F.lit(k) for k in range(deepest)])

    def step(x: Column, t: Column, at: Column) -> Column:
        node = F.get(t, at)
        return F.when(node["j"] < 0, at).when(F.get(x, node["j"]) <= node["cut"], node["low"]).otherwise(node["high"])

    def walk(x: Column, t: Column, root: Column) -> Column:
        return F.get(t, F.aggregate(steps, root, lambda at, _: step(x, t, at)))["value"]

    total = lambda x, t: F.aggregate(F.array(*[F.lit(k) for k in roots]), F.lit(0.0), lambda sum_, root: sum_ + walk(x, t, root))
    return let(F.array(*inputs), lambda x: let(table, lambda t: total(x, t))) / F.lit(float(len(forest)))


def train_forest(spark: SparkSession, findings: list[tuple[str, str, str, str, int]] | None = None) -> list:
    """Train on labelled findings (the made ones by default) through the same expressions as the scan."""
    rows = json.dumps([{"value": v, "before": b, "path": p, "after": a, "label": y} for v, b, p, a, y in findings or labelled_findings()])
    table = spark.range(1).select(F.inline(F.from_json(F.lit(rows), "array<struct<value:string,before:string,path:string,after:string,label:int>>")))
    got = table.select(F.array(*features(F.col("value"), F.col("before"), F.col("path"), F.col("after"))).alias("x"), "label").collect()
    return grow(np.array([r.x for r in got]), np.array([r.label for r in got], dtype=float))


def scan_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source", forest: list | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """One row per candidate: (id, line_no, start, stop, value, probability, is_secret).

    line_no counts from 1, start and stop (exclusive) are characters of the line; a block's stop counts on through the
    lines that it takes. Rejected candidates stay, with is_secret false. Texts and lines of any length are read whole. Null and empty texts give no row, a null path has no path feature, a null id stays null. Rows
    that repeat give their candidates each; an empty table gives an empty result; extra columns are ignored.
    """
    forest = forest if forest is not None else train_forest(df.sparkSession)
    path = F.col(path_col) if path_col else F.lit(None).cast("string")
    lines = df.select(F.col(id_col).alias("id"), path.alias("path"), F.posexplode(F.split(text_col, "\n")).alias("line_no", "line"))
    lines = lines.where(F.regexp_like("line", F.lit(CANDIDATE)) | F.regexp_like("line", F.lit(f"{BEFORE_ASSIGNED}(?:{ASSIGNED})")))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("stops"))

    def stops(steps: str) -> Column:
        return F.aggregate(steps, zero, lambda acc, s: F.struct((acc["at"] + F.length(s)).alias("at"), F.concat(acc["stops"], F.array(acc["at"] + F.length(s))).alias("stops")))["stops"]

    def found(stops: str):
        def one(value: Column, k: Column) -> Column:
            stop = F.get(stops, k)
            start = stop - F.length(value)
            first = F.greatest(start - AROUND, F.lit(0))
            return F.struct(value.alias("value"), start.alias("start"), stop.alias("stop"), F.substr("line", first + 1, start - first).alias("before"), F.substr("line", stop + 1, F.lit(AROUND)).alias("after"))

        return one

    rows = lines
    for form, pattern in (("key", f"({CANDIDATE})"), ("named", f"{BEFORE_ASSIGNED}({ASSIGNED})")):
        # \G: every search goes on where the last match ended, so a line is read once
        pattern = F.lit(rf"\G(?s:.*?){pattern}")
        rows = rows.withColumn(f"{form}_steps", F.regexp_extract_all("line", pattern, F.lit(0))).withColumn(f"{form}_values", F.regexp_extract_all("line", pattern, F.lit(1)))
    rows = rows.withColumn("key_stops", stops("key_steps")).withColumn("named_stops", stops("named_steps"))
    # an assigned value that is a run of key characters with a digit is found as such already
    new = F.filter(F.transform("named_values", found("named_stops")), lambda c: ~F.regexp_like(c["value"], F.lit(rf"^(?:{CANDIDATE})$")))
    rows = rows.select("id", "path", "line_no", F.explode(F.concat(F.transform("key_values", found("key_stops")), new)).alias("c"))
    rows = rows.select("id", "path", (F.col("line_no") + 1).alias("line_no"), "c.*")
    texts = df.where(F.contains(F.col(text_col), F.lit("PRIVATE KEY"))).select(F.col(id_col).alias("id"), path.alias("path"), F.col(text_col).alias("text"))
    blocks = texts.select("id", "path", F.split("text", "\n").alias("lines"), F.explode(matches(F.col("text"), BLOCK)).alias("m"))
    start = F.instr(F.get("lines", F.col("m.line_no") - 1), F.substring("m.match", 1, 16)) - 1
    none = F.lit("")
    blocks = blocks.select("id", "path", "m.line_no", F.col("m.match").alias("value"), start.alias("start"), (start + F.length("m.match")).alias("stop"), none.alias("before"), none.alias("after"))
    probability = as_column(forest, features(F.col("value"), F.col("before"), F.col("path"), F.col("after")))
    out = rows.unionByName(blocks).withColumn("probability", probability)
    return out.select(F.col("id").alias(id_col), "line_no", "start", "stop", "value", "probability", (F.col("probability") >= threshold).alias("is_secret"))
