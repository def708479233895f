"""Secret scan: candidates by pattern, false positives removed by a random forest, in DataFrame functions alone."""

from __future__ import annotations

import random
import string

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import attach, read_table, text_of
from .forest import forest_sql, grow_forest

#: Labelled findings of each class that the forest is trained on.
FINDINGS = 1500
THRESHOLD = 0.5
SEED = 17
TOKEN = "[A-Za-z0-9+/_.=-]"
#: Words that name a secret, and words that name something else that looks like one.
SECRET_CUES = "token|secret|passw|pwd|api[_-]?key|apikey|auth|bearer|credential|private|access[_-]?key|aws|client[_-]?key|signing"
OTHER_CUES = "sha|md5|commit|checksum|digest|hash|uuid|guid|revision|build|version|isbn|order|invoice|tracking|etag|rev|phone|card|account|serial|image|file|path|url|http"
#: Names of values that may be short, and where a word ends one value and begins the next.
NAMES = r"(?i)(passw\w*|pwd|secret\w*|\w*token|api_?key|access_?key|auth\w*)[\"']?"
LONG = r"[A-Za-z0-9+/_=-]{16,}"
BETWEEN = r"[,;&?{}()\[\]|<>]++(?!$)|(?<=[A-Za-z0-9+/_=-]{16})(?<=[0-9][A-Za-z+/_=-]{0,15})[^A-Za-z0-9+/_.=-]++(?!$)"
#: Common English words and parts of names; a candidate made of them is no random string.
DICTIONARY = (
    "the and for that with this from have not are was but they his her you all one out about who get which when make can like time just him know take people into year your good some could them see other than then now look only come its over think also back after use two how our work first well way even new want because any these give day most"
    " key token secret password access client server config test example sample value string number user name data file path image version build release default local remote main index page item list node type code text time date hash link home lib src bin usr var tmp opt api web app net com org http https www html json xml yaml"
).split()
FEATURES = ["len", "digits", "uppers", "lowers", "switches", "variety", "dictionary", "slashes", "marks", "hexlike", "digits_only", "quoted", "assigned", "secret_near", "other_near", "known_prefix"]


def features(word: Column, before: Column, after: Column) -> dict[str, Column]:
    """What the forest sees of a candidate: the token in its word, and the words before and after."""
    core = F.regexp_extract(word, f"({TOKEN}{{8,}})[^A-Za-z0-9+/_.=-]*$", 1)
    token = F.regexp_extract(core, "([^=]*=*)$", 1)
    token = F.when(F.length(token) >= 8, token).otherwise(core)
    n = F.greatest(F.length(token), F.lit(1)).cast("double")
    share = lambda pattern: F.regexp_count(token, F.lit(pattern)) / n
    words = "|".join(sorted({w for w in DICTIONARY if len(w) >= 3}, key=lambda w: (-len(w), w)))
    # What stands in the word before the token, as in name="token".
    rest = F.length(word) - F.length(F.regexp_extract(word, "[^A-Za-z0-9+/_.=-]*$", 0)) - F.length(token)
    head = F.substr(word, F.lit(1), F.greatest(rest, F.lit(0)))
    near = F.lower(F.concat_ws(" ", before, head))
    return {
        "len": n,
        "digits": share("[0-9]"),
        "uppers": share("[A-Z]"),
        "lowers": share("[a-z]"),
        "switches": share("(?<=[a-z])[^a-z]|(?<=[A-Z])[^A-Z]|(?<=[0-9])[^0-9]"),
        "variety": F.size(F.array_distinct(F.split(token, ""))) / F.least(n, F.lit(64.0)),
        "dictionary": 1 - F.length(F.regexp_replace(F.lower(token), words, "")) / n,
        "slashes": share("/"),
        "marks": share("[._-]"),
        "hexlike": token.rlike("^[0-9a-f]+$|^[0-9A-F]+$").cast("double"),
        "digits_only": token.rlike("^[0-9._-]+$").cast("double"),
        "quoted": word.rlike("[\"'`]").cast("double"),
        "assigned": (word.rlike("[:=]") | before.rlike("[:=]\\s*$")).cast("double"),
        "secret_near": near.rlike(SECRET_CUES).cast("double"),
        "other_near": F.lower(F.concat_ws(" ", before, head, after)).rlike(OTHER_CUES).cast("double"),
        "known_prefix": token.rlike("^(AKIA|ASIA|ghp_|gho_|github_pat_|sk_live_|sk-|xox[abp]-|glpat-|AIza|eyJ|npm_)").cast("double"),
    }


def labelled_findings(n: int = FINDINGS, seed: int = SEED) -> list[tuple[str, str, str, int]]:
    """(before, word, after, label): findings as a scanner reports them, with the verdict; n of either class.

    Drawn from the public formats of access keys and tokens, and of what scanners mistake for them: checksums, commits,
    identifiers, paths, addresses, card and order numbers, placeholders, names in code, and glued prose.
    """
    r = random.Random(seed)
    hexes, alnum, b64 = "0123456789abcdef", string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/"
    of = lambda chars, k: "".join(r.choice(chars) for _ in range(k))
    prose = lambda: r.choice(DICTIONARY)
    names = ["token", "api_key", "secret", "password", "auth_token", "access_key", "client_secret", "aws_secret_access_key", "TOKEN", "API_KEY", "SECRET_KEY", "Authorization:"]

    def secret() -> str:
        return r.choice([lambda: of(hexes, r.choice((32, 40, 40, 64))), lambda: of(hexes.upper(), 40), lambda: of(alnum, r.randint(20, 48)), lambda: of(b64, 40), lambda: "AKIA" + of(string.ascii_uppercase + string.digits, 16), lambda: "ghp_" + of(alnum, 36), lambda: "sk_live_" + of(alnum, 24), lambda: "eyJ" + of(alnum, 30) + "." + of(alnum, 40), lambda: of(alnum + "!", 12), lambda: of(string.ascii_letters, r.randint(20, 40)), lambda: of(alnum, r.randint(8, 15)), lambda: of(string.ascii_lowercase, r.randint(3, 7)) + of(string.digits, r.randint(1, 3)) + of(string.ascii_lowercase + "!-", r.randint(4, 7))])()

    def positive() -> tuple[str, str, str]:
        s, name = secret(), r.choice(names)
        q = r.choice(['"{}"', "'{}'", "{}", '"{}"'])
        tail = r.choice(["", "", "", ",", ";", "###", "!!", "$$$", "."])
        shape = r.random()
        if shape < 0.6:
            return f"{name} {r.choice('=:')}", q.format(s) + tail, prose()
        if shape < 0.85:
            return f"{prose()} {prose()}", name + r.choice("=:") + q.format(s) + tail, prose()
        return f"{prose()} {r.choice(['Bearer', 'bearer', 'token', 'key'])}", (s if len(s) > 16 else "AKIA" + of(string.ascii_uppercase + string.digits, 16)) + tail, prose()

    def negative() -> tuple[str, str, str]:
        glue = lambda k: "".join(prose() for _ in range(k))
        kind = r.randrange(16)
        tail = r.choice(["", "", ",", ".", "###", "!!", "$$$"])
        if kind == 0:
            return r.choice(["commit", "Merge commit", "sha1 :", "rev =", "git revision"]), of(hexes, 40) + tail, prose()
        if kind == 1:
            return r.choice(["md5 =", "sha256 :", "checksum", "digest =", "etag :"]), r.choice(["{}", '"{}"']).format(of(hexes, r.choice((32, 64)))) + tail, prose()
        if kind == 2:
            u = of(hexes, 32)
            return r.choice(["id =", "uuid :", prose(), "request"]), f"{u[:8]}-{u[8:12]}-{u[12:16]}-{u[16:20]}-{u[20:]}" + tail, prose()
        if kind == 3:
            return f"{prose()} {prose()}", "/".join(["", *(prose() for _ in range(r.randint(3, 6)))]) + f"{r.randint(1, 99)}.{r.choice(['py', 'txt', 'html'])}", prose()
        if kind == 4:
            return f"{prose()} {prose()}", f"https://{glue(2)}.com/{prose()}/{r.randint(10, 99999)}" + tail, prose()
        if kind in (5, 6):
            return r.choice([f"{prose()} {prose()}", "order", "card", prose(), "token is", "the key"]), of(string.digits, r.choice((16, 16, 16, 18, 20))) + tail, prose()
        if kind == 7:
            return f"{r.choice(names)} =", r.choice(['"your_api_key_here1"', '"xxxxxxxxxxxxxxxx1"', '"0000000000000000"', '"changeme_changeme1"', '"1234567890123456"', '"<token_value_here1>"', '"example_secret_key_1"', "password12345678"]), prose()
        if kind == 8:
            return f"{prose()} {prose()}", "_".join(prose() for _ in range(4)) + str(r.randint(1, 99)) + tail, prose()
        if kind == 9:
            return f"{prose()} {prose()}", "".join(prose().capitalize() for _ in range(4)) + str(r.randint(1, 99)) + tail, prose()
        if kind == 10:
            return f"{prose()} {prose()}", f"20{r.randint(10, 29)}-{r.randint(10, 12)}-{r.randint(10, 28)}T{r.randint(10, 23)}:{r.randint(10, 59)}:{r.randint(10, 59)}" + tail, prose()
        if kind == 11:
            return f"{prose()} {prose()}", r.choice([glue(5), "_".join(prose() for _ in range(5)), "/" + "/".join(prose() for _ in range(5)), "".join(prose().capitalize() for _ in range(5))]) + tail, prose()
        if kind == 12:
            return f"{prose()} {r.choice(names)}{r.choice([':', ' =', ' :'])}", r.choice([glue(2), glue(3), "_".join(prose() for _ in range(3)), "required", "get_" + prose() + "_value"]) + tail, prose()
        if kind == 13:
            return f"{prose()} {prose()}", f'"{prose()}":"' + r.choice([glue(4), "/" + "/".join(prose() for _ in range(4)), f"https://{glue(2)}.com/{prose()}"]) + '"' + tail, prose()
        if kind == 14:
            return f"{prose()} {prose()}", f"https://{glue(2)}.com/{prose()}/{prose()}_{prose()}" + tail, prose()
        return r.choice(["version", "build", "release"]), f"{r.randint(1, 30)}.{r.randint(0, 20)}.{r.randint(0, 20)}-{prose()}.{r.randint(1000, 99999)}" + tail, prose()

    return [(*positive(), 1) for _ in range(n)] + [(*negative(), 0) for _ in range(n)]


def train_forest(spark: SparkSession, findings: list[tuple[str, str, str, int]] | None = None) -> list:
    """The forest for labelled findings, whose features Spark computes by the same expressions as for documents."""
    rows = spark.createDataFrame(findings or labelled_findings(), "before string, word string, after string, label int").coalesce(1)
    made = rows.select("label", *[c.alias(n) for n, c in features(F.col("word"), F.col("before"), F.col("after")).items()]).collect()
    x, y = np.array([[float(r[n]) for n in FEATURES] for r in made]), np.array([r["label"] for r in made])
    return grow_forest(x, y)


def secret_findings(docs: DataFrame, trees: list, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, at, word, score): every candidate of every text; ``at`` is the number of its word in the text.

    A candidate is a part of a word that holds 16 token characters in a row, or 8 characters or more assigned to a name
    like password in the word or in those before; or a word in the first line of a private key. Words are cut into parts
    where one value ends and the next begins, as in JSON without blanks or a query; if no part is one, the word may be.
    """
    words = docs.select(F.col(id_col).alias("id"), F.split(text_of(text_col), r"[\x20\x09-\x0D]+").alias("words"))
    named = NAMES + r"[:=][\"']?[^\s\"']{8,}"
    get = lambda i: F.coalesce(F.get("words", i), F.lit(""))
    follows = lambda i: F.concat_ws(" ", get(i - 2), get(i - 1)).rlike(NAMES + r"\s*[:=]+$")
    alone = lambda w: ((F.length(w) >= 16) & w.rlike(LONG)) | ((F.length(w) >= 12) & w.rlike("[:=]") & w.rlike(named))

    def parts(w: Column, i: Column) -> Column:
        cut = F.split(w, BETWEEN)
        own = F.filter(cut, lambda x, k: alone(x) | ((k == 0) & (F.length(x) >= 8) & follows(i)))
        whole = F.when(alone(w) | follows(i), F.array(w)).otherwise(F.array().cast("array<string>"))
        return F.when(w == "PRIVATE", F.array(w)).when(F.length(w) < 8, F.array().cast("array<string>")).when(F.size(own) > 0, own).otherwise(whole)

    numbered = F.transform("words", lambda w, i: F.transform(parts(w, i), lambda x: F.struct(i.alias("at"), x.alias("word"))))
    found = words.select("id", "words", F.explode(F.flatten(numbered)).alias("c"))
    at = F.col("c.at")
    word = lambda k: F.coalesce(F.get("words", at + F.lit(k)), F.lit(""))
    before = F.concat_ws(" ", word(-2), word(-1))
    found = found.select("id", at.alias("at"), F.col("c.word").alias("word"), before.alias("before"), word(1).alias("after"))
    # A private key is known by its first line: BEGIN ... PRIVATE KEY.
    key_line = (F.col("word") == "PRIVATE") & F.col("before").contains("BEGIN") & F.col("after").startswith("KEY---")
    found = found.filter((F.col("word") != "PRIVATE") | key_line)
    made = found.select("*", *[c.cast("double").alias(n) for n, c in features(F.col("word"), F.col("before"), F.col("after")).items()])
    return made.select("id", "at", "word", F.when(F.col("word") == "PRIVATE", 1.0).otherwise(F.expr(forest_sql(trees, FEATURES))).alias("score"))


def secret_scan(docs: DataFrame, threshold: float = THRESHOLD, trees: list | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_candidates, n_secrets, secrets`` per row; ``secrets`` are (at, word, score) in the order of the text.

    Null, empty and blank texts have no candidate. Rows that repeat an id are one document with the findings of all, each
    counted once a row, and are reported for each; a null id is an id. An empty table gives an empty result; other
    columns are ignored, whatever their names. Positions count words; a text that begins with white space has an empty
    word 0.
    """
    trees = trees or train_forest(docs.sparkSession)
    found = secret_findings(docs, trees, id_col, text_col)
    kept = F.col("score") >= threshold
    per_doc = found.groupBy("id").agg(F.count("*").alias("n_candidates"), F.sum(kept.cast("long")).alias("n_secrets"), F.sort_array(F.collect_list(F.when(kept, F.struct("at", "word", "score")))).alias("secrets"))
    out = attach(docs.select(F.col(id_col).alias("id")), per_doc, "id")
    none = F.array().cast("array<struct<at: int, word: string, score: double>>")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_candidates", F.lit(0)).cast("long").alias("n_candidates"), F.coalesce("n_secrets", F.lit(0)).cast("long").alias("n_secrets"), F.coalesce("secrets", none).alias("secrets"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan(read_table(spark, sf_dir, "documents"))
    spans = F.array_join(F.transform("secrets", lambda x: F.concat_ws(":", x["at"], F.sha2(x["word"], 256))), ",")
    return found.select("doc_id", "n_candidates", "n_secrets", spans.alias("secrets"))
