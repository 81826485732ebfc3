"""Secret scan with a random forest against false positives (operator 4), in DataFrame and
``pyspark.ml`` functions only.

Candidates are the values assigned to a word that names a secret, of any length and any
characters up to the closing quote on the line or, without quotes, up to white space or a
quote; and besides them all unbroken runs of at least twelve key characters. The forest
judges each by its length, its changes between kinds of characters, how much of its letters
dictionary words cover (the dictionary: words the corpus itself uses often), the path it was
found under and the words next to it. It is trained from labelled findings; at most
``max_labelled`` of them, picked by a hash, evenly from those with and without a digit of
either label, so that the fit does not grow with the corpus and plain words do not crowd out
the rest; and from ``examples`` labelled findings made by rule (``example_texts``), which show
keys, pass phrases, bearer tokens and key bodies beside what only looks like them: place
holders, code expressions, commit hashes, checksums, uuids, inline data. Words are counted
and candidates found over all whole texts.

Labels only train: the forest decides on every finding, labelled or not. Findings keep their
value, place and score; ``redact`` replaces the values found to be secrets. Defined cases: null
and empty texts have no candidates; without examples and with labels that are all alike, or
without any, every finding takes that share of positives (none: 0.5, so it stays a finding);
repeated rows have findings of their own, judged alike; null ids and paths count as empty; an
empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from notecover.llm import common as C

MASK = "[SECRET]"
#: Words that name a secret, and prefixes that only issued keys have.
KEY_WORDS = ("password", "passwd", "pwd", "secret", "token", "api_key", "apikey", "access_key", "auth")
KEY_PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "glpat-", "xoxb-", "xoxp-", "sk_live_")
#: A name that ends in a key word, and what assigns (=, ==, :=, =>, :) up to the value's opening quote.
_ASSIGNS = "[\"']?+\\s*+(?::?+=++>?+|:(?!:))\\s*+"
_FIRST = "".join(sorted({c for w in KEY_WORDS for c in w[0] + w[0].upper()}))
_NAMED = "[A-Za-z0-9+/_-]*?(?=[" + _FIRST + "])(?i:" + "|".join(KEY_WORDS) + ")" + _ASSIGNS
HEAD = "^" + _NAMED + "[\"']?(?=[\\s\\S])"
CANDIDATE = ("(?<![A-Za-z0-9+/_-])(?:" + _NAMED + "(?:\"[^\"\\r\\n]+(?=\")|'[^'\\r\\n]+(?=')|[\"']?[^\\s\"']+)"
             "|[A-Za-z0-9+/_-]{12,}={0,2})")


@dataclass(frozen=True)
class SecretScan:
    trees: int = 20
    depth: int = 8
    max_labelled: int = 20_000
    examples: int = 6_000        # labelled findings made by rule that train beside those of the corpus
    context: int = 48            # characters of the text looked at on either side for the next word
    slots: int = 24              # hashed slots for the word before, the word after and the path
    dictionary_count: int = 20   # a dictionary word occurs so often, or once in dictionary_share words
    dictionary_share: int = 1_000_000
    dictionary_letters: int = 32     # longer runs of letters are no words
    threshold: float = 0.5
    seed: int = 11


_MARK = "\u0001"


def _parts(text: Column) -> Column:
    """Text before the first candidate, the candidate, text up to the next one, and so on, by one
    search: candidates are marked on either side and the text split at the marks. Texts that hold the
    mark themselves are searched twice."""
    once = F.split(F.regexp_replace(text, CANDIDATE, _MARK + "$0" + _MARK), _MARK, -1)
    hits, between = F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)), F.split(text, CANDIDATE, -1)
    twice = F.slice(F.flatten(F.zip_with(between, hits, lambda b, v: F.array(b, v))), 1, 2 * F.size(hits) + 1)
    twice = F.transform(twice, lambda x: F.coalesce(x, F.lit("")))
    return F.when(F.contains(text, F.lit(_MARK)), twice).otherwise(once)


def _every_second(parts: str, first: int) -> Column:
    return F.expr(f"filter({parts}, (x, i) -> i % 2 = {first})")


def candidates(docs: DataFrame, p: SecretScan) -> DataFrame:
    """(doc, doc_id, path, k, start, value, before, after): k-th candidate of a text, its
    start in characters from 0, and the text next to it. ``doc`` identifies id and text."""
    d = C.only(docs, doc_id="bigint", text="string", source="string").withColumn("text", F.coalesce("text", F.lit("")))
    found = d.select("doc_id", F.coalesce("source", F.lit("")).alias("path"), F.xxhash64("doc_id", "text").alias("doc"), _parts(F.col("text")).alias("parts"))
    found = found.select("doc", "doc_id", "path", _every_second("parts", 1).alias("hits"), _every_second("parts", 0).alias("between"))
    found = found.withColumn("heads", F.transform("hits", lambda v: F.regexp_extract(v, HEAD, 0)))
    # the pieces between the candidates give the places: sums of lengths, without another search
    starts = F.expr("aggregate(zip_with(slice(between, 1, size(hits)), hits, (b, v) -> struct(length(b) as b, length(v) as v)),"
                    " cast(struct(0 as at, cast(array() as array<int>) as starts) as struct<at:int, starts:array<int>>),"
                    " (a, x) -> struct(a.at + x.b + x.v as at, array_append(a.starts, a.at + x.b) as starts), a -> a.starts)")
    # only what a candidate needs is exploded, not the whole text with each of them
    each = F.expr("transform(hits, (v, k) -> struct(k as k, starts[k] + length(heads[k]) as start, substring(v, length(heads[k]) + 1) as value,"
                  f" right(concat(if(k > 0, hits[k - 1], ''), between[k], regexp_replace(heads[k], '[ \\\\t\\\\r\\\\n]+', ' ')), {p.context}) as before,"
                  f" left(concat(between[k + 1], if(k + 1 < size(hits), hits[k + 1], '')), {p.context}) as after))")
    return found.withColumn("starts", starts).select("doc", "doc_id", "path", F.explode(each).alias("c")).select("doc", "doc_id", "path", "c.*")


def dictionary(docs: DataFrame, p: SecretScan) -> DataFrame:
    """(word): words of three letters or more that the corpus uses often, in lower case; at
    most ``dictionary_share`` of them whatever the corpus."""
    words = (C.only(docs, text="string").select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("word"))
             .filter(F.length("word").between(3, p.dictionary_letters)).groupBy("word").count())
    total = words.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("total"))
    often = F.greatest(F.lit(p.dictionary_count), F.col("total") / p.dictionary_share)
    return words.join(F.broadcast(total)).filter(F.col("count") >= often).select("word")              # total: one row


def _word(c: Column, last: bool) -> Column:
    run = "([A-Za-z_]+)[^A-Za-z_]*$" if last else "^[^A-Za-z_]*([A-Za-z_]+)"
    return F.lower(F.regexp_extract(c, run, 1))


def _slots(c: Column, p: SecretScan, salt: int) -> Column:
    at = F.pmod(F.xxhash64(F.lit(salt), c), F.lit(p.slots)).cast("int")
    return F.concat(F.array_repeat(F.lit(0.0), at), F.array(F.lit(1.0)), F.array_repeat(F.lit(0.0), F.lit(p.slots - 1) - at))


def covered(found: DataFrame, words: DataFrame) -> DataFrame:
    """``found`` with ``covered``: how many letters of each value dictionary words cover. The
    dictionary is broadcast: at most ``dictionary_share`` words of ``dictionary_letters`` letters."""
    once = found.select("doc", "k", "value").distinct()                                       # repeated rows count once
    runs = (once.select("doc", "k", F.explode(F.regexp_extract_all("value", F.lit("[A-Za-z]{3,}"), F.lit(0))).alias("run"))
            .select("doc", "k", F.lower("run").alias("word")))
    letters = runs.join(F.broadcast(words), "word").groupBy("doc", "k").agg(F.sum(F.length("word")).alias("covered"))
    return found.join(letters, ["doc", "k"], "left")


def features(found: DataFrame, p: SecretScan) -> DataFrame:
    """``found``, with ``covered``, with a feature vector for each finding."""
    n = F.length("value").cast("double")

    def share(pattern: str) -> Column:
        return F.regexp_count("value", F.lit(pattern)) / n

    letters = F.greatest(F.regexp_count("value", F.lit("[A-Za-z]")), F.lit(1))
    numbers = F.array(
        n, share("[0-9]"), share("[a-z]"), share("[A-Z]"), share("[+/_=-]"),
        share("[A-Za-z](?=[0-9])"), share("[0-9](?=[A-Za-z])"), share("[a-z](?=[A-Z])"), share("[A-Z](?=[a-z])"),
        share("[0-9](?=[0-9])"), share("[a-f0-9]"), F.size(F.array_distinct(F.split("value", ""))) / n,
        F.coalesce("covered", F.lit(0)) / letters,
        F.length("path").cast("double"), F.size(F.split("path", "/")).cast("double"), F.col("path").rlike("(?i)test|example|sample|doc").cast("double"),
        share("[^A-Za-z0-9+/_=-]"), share("[aeiouyAEIOUY](?=[b-df-hj-np-tv-xzB-DF-HJ-NP-TV-XZ])"), share("(.)(?=\\1)"),
        *(F.col("value").rlike(x).cast("double") for x in (EXPRESSION, PLACE_HOLDER, UUID, "^[A-Fa-f0-9]+$", "[0-9]")),
        *(F.col("value").startswith(x).cast("double") for x in KEY_PREFIXES),
        *(F.col("before").rlike(x).cast("double") for x in (ASSIGNED, NAMES_SECRET, NAMES_DIGEST)), F.col("after").rlike("^[\"']").cast("double"))
    vector = F.concat(numbers, _slots(_word(F.col("before"), True), p, 1), _slots(_word(F.col("after"), False), p, 2), _slots(F.col("path"), p, 3))
    return found.withColumn("features", array_to_vector(F.transform(vector, lambda x: x.cast("double"))))


ASSIGNED = "[=:]>?\\s*[\"']?$"
#: Shapes of values and names that features look at; none decides alone.
EXPRESSION = "^(?:[$%<{(\\[]|[A-Za-z_][A-Za-z0-9_]*(?:\\.[A-Za-z_][A-Za-z0-9_]*)*[\\[(]|[A-Za-z_]+(?:\\.[A-Za-z_]+)+$)"
PLACE_HOLDER = ("(?i)^(?:none|null|nil|true|false|required|optional|missing|invalid|expired|undefined|unknown|todo|tbd|example|sample|dummy|"
                "change_?-?me|redacted|placeholder|string|(?:your|my|the|insert|enter)[-_ ].*|[x*.-]{3,})[,.;)]*$")
UUID = "^[A-Fa-f0-9]{8}(?:-[A-Fa-f0-9]{4}){3}-[A-Fa-f0-9]{12}$"
NAMES_SECRET = "(?i)(?:" + "|".join((*KEY_WORDS, "bearer", "credential", "passphrase", "private[ _-]?key", "signing[ _-]?key")) + ")[\"'\\s=:>-]*$"
NAMES_DIGEST = ("(?i)(?:^|[^a-z])(?:commit|sha-?[0-9]*|md5|checksum|digest|etag|revision|rev|hash|blob|tree|build|id|uuid|guid|trace|base64)"
                "[\"'\\s=:>,-]*$")
#: Words in one case, or with a capital first letter, one or several joined.
PLAIN = "^[+/_-]*[A-Za-z]?([a-z]*|[A-Z]*)([+/_-]+([A-Za-z]?([a-z]*|[A-Z]*)))*=*$"


def format_labels(found: DataFrame) -> DataFrame:
    """Labelled findings from formats that speak for themselves, to train on: (doc, k, label). An
    issued key's prefix, or a value assigned to a key word, is a secret; place holders, code
    expressions, uuids, hashes named as such, digits only, or plain words that nothing is
    assigned, are none; the rest, also keys that nothing is assigned and bare words after a
    key word and a colon, stays without a label."""
    name = "(?i)(" + "|".join(KEY_WORDS) + ")" + _ASSIGNS + "[\"']?$"
    issued = F.lit(False)
    for prefix in KEY_PREFIXES:
        issued = issued | F.col("value").startswith(prefix)
    value, before = F.col("value"), F.col("before")
    plain = value.rlike(PLAIN) & ~before.rlike(ASSIGNED)
    stand_in = value.rlike(PLACE_HOLDER) | value.rlike(EXPRESSION)
    digest = before.rlike(NAMES_DIGEST) & value.rlike("^[A-Fa-f0-9]+$") & ~before.rlike(name)
    open_ = value.rlike("^[A-Za-z]{2,}[,.;]?$") & before.rlike(":\\s*$")
    label = (F.when(issued, 1.0).when(before.rlike(name) & stand_in, 0.0).when(before.rlike(name) & ~open_, 1.0)
             .when(value.rlike("^[0-9+/_=-]+$") | value.rlike(UUID) | digest | plain, 0.0))
    return found.select("doc", "k", label.alias("label")).filter("label is not null")


_WORDS = 16


def example_texts(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    """(doc_id, text, source, want, label): n texts made by rule, each with one value ``want`` that
    is a secret (1) or only looks like one (0). Values come from hashes of the row's number."""
    digits, beginnings, endings = "0123456789abcdef", "bcdfglmnprstvrnl", "aeiouaeioeaioeau"
    spoken = F.expr(f"transform(sequence(1, {_WORDS}), w -> aggregate(split(substring(sha2(concat_ws('-', id, {seed}, w), 256), 1, 4 + cast(pmod(xxhash64(id, w), 5) as int)), ''), '',"
                    f" (a, c) -> concat(a, if(length(a) % 2 = 0, translate(c, '{digits}', '{beginnings}'), translate(c, '{digits}', '{endings}')))))")
    hashed = F.expr(f"transform(sequence(1, 5), w -> sha2(concat_ws('-', 'h', id, {seed}, w), 256))")
    base = C.cut_lineage(spark.range(n).select("id", spoken.alias("words"), hashed.alias("hashes"),
                                               F.regexp_replace(F.concat(*(F.base64(F.unhex(F.sha2(F.concat_ws("-", F.lit(x), "id", F.lit(seed)), 256))) for x in "ab")), "=", "").alias("code")))

    def pick(salt: int, *items) -> Column:
        at = F.pmod(F.xxhash64("id", F.lit(seed), F.lit(salt)), F.lit(len(items)))
        return F.element_at(F.array(*(x if isinstance(x, Column) else F.lit(x) for x in items)), at.cast("int") + 1)

    def hexes(k: int) -> Column:
        return F.col("hashes")[k]

    def word(k: int) -> Column:                                                # may be said aloud, is in no dictionary
        return F.col("words")[k % _WORDS]

    def size(salt: int, low: int, high: int) -> Column:
        return low + F.pmod(F.xxhash64("id", F.lit(seed), F.lit(salt)), F.lit(high - low + 1)).cast("int")

    def cut(c: Column, salt: int, low: int, high: int) -> Column:
        return F.substring(c, F.lit(1), size(salt, low, high))

    key = pick(1, "token", "password", "secret", "api_key", "access_key", "auth", "client_secret", "db_password", "API_TOKEN", "SECRET_KEY", "pwd", "passwd")
    key = F.when(key == "SECRET_KEY", "APP_SECRET").otherwise(key)             # the key word ends the name
    digest = pick(2, "commit", "sha1", "sha256", "md5", "checksum", "digest", "etag", "revision", "hash", "blob", "tree", "build")
    ident = pick(3, "id", "uuid", "request_id", "trace", "guid", "build_id")
    assign = pick(4, " = ", "=", ": ", " := ", ":")
    quote = pick(5, "\"", "'")
    maybe = pick(6, "\"", "", "'", "")
    hexed = pick(7, F.substring(hexes(0), 1, 40), F.substring(hexes(0), 1, 32), hexes(0))
    uuid = F.concat_ws("-", F.substring(hexes(1), 1, 8), F.substring(hexes(1), 9, 4), F.substring(hexes(1), 13, 4), F.substring(hexes(1), 17, 4), F.substring(hexes(1), 21, 12))
    mixed = F.concat(word(11), pick(12, "1", "2024", "7!", "_9", "@3", "#x1"), pick(13, "", F.initcap(word(14)), "$"))
    signs = F.concat(word(15), pick(16, "$%", "!", "@#", "&"), word(17))
    phrase = pick(18, F.concat_ws("-", word(11), word(12), word(13)), F.concat_ws(" ", word(11), word(12), word(13)), F.concat_ws("-", word(14), word(15)), F.lit("x"), cut(F.col("code"), 20, 2, 6))
    stand_in = pick(21, "changeme", "your-token-here", "<token>", "${SECRET}", "xxxxxxxx", "********", "TODO", "example", "redacted", "your_api_key", "required", "null")
    said = pick(22, "required", "None", "null", "optional", "true", "false", "missing", "invalid", "expired", "string", "unknown", word(23), word(24), word(25), word(26))
    code_word = pick(27, "os.environ[KEY]", "getenv(NAME)", "config.get_token()", "settings.SECRET", "self.token", "request.headers[AUTH]", "$TOKEN", "${PASSWORD}",
                     "{{secret}}", "<password>", "args.password", F.format_string("%s.%s()", word(28), word(29)), F.format_string("%s[%s]", word(28), word(29)), F.concat(F.lit("$"), F.upper(word(28))))
    name = pick(30, F.concat_ws("_", word(31), word(32), word(33)), F.concat(word(31), F.initcap(word(32)), F.initcap(word(33))), F.concat_ws("/", F.lit("src"), word(31), word(32), word(33)),
                F.concat_ws("-", word(31), word(32), word(33)), F.concat(word(31), word(32), word(33)), F.concat(word(31), F.lit("-2024-01-"), F.substring(hexes(2), 1, 2), F.lit("-"), word(33)))
    issued = F.concat(pick(35, *KEY_PREFIXES), pick(36, cut(F.col("code"), 38, 20, 40), F.upper(F.substring(hexes(3), 1, 16))))
    lead, tail = pick(40, word(41), F.concat(word(41), F.lit(" the")), F.lit(""), F.concat(word(41), F.lit(","))), pick(42, word(43), F.lit(""), F.lit("and"), F.lit("\n"))
    body = cut(F.col("code"), 45, 24, 80)
    kinds = [                                                                  # (label, before, value, after)
        (1, F.concat(key, assign, maybe), hexed, maybe), (0, F.concat(digest, assign, maybe), hexed, maybe),
        (1, F.concat(key, assign, maybe), body, maybe), (0, F.concat(key, assign), said, F.lit("")),
        (1, F.concat(key, assign, maybe), mixed, maybe), (0, F.concat(key, assign), code_word, F.lit("")),
        (1, F.concat(key, assign, quote), phrase, quote), (0, F.concat(key, assign, quote), stand_in, quote),
        (1, F.concat(key, assign), signs, F.lit("")), (0, F.concat(ident, assign, maybe), uuid, maybe),
        (1, pick(46, "Bearer ", "Authorization: Bearer ", "bearer "), F.concat(pick(47, "eyJ", ""), body), F.lit("")), (0, pick(48, "", "at ", "in "), name, F.lit("")),
        (1, F.concat(F.lit("-----BEGIN "), pick(49, "", "RSA ", "EC "), F.lit("PRIVATE KEY-----\n")), body, F.lit("")), (0, F.concat(digest, F.lit(" ")), hexed, F.lit("")),
        (1, pick(50, "", "key ", "aws_key = ", "use "), issued, F.lit("")), (0, pick(51, F.lit("data:image/png;base64,"), F.concat(word(52), F.lit(" ")), F.concat(F.lit("-----BEGIN CERTIFICATE-----\n"))), F.when(pick(51, F.lit(True), F.lit(False), F.lit(True)), body).otherwise(hexed), F.lit("")),
    ]
    parts = F.element_at(F.array(*(F.struct(F.lit(float(y)).alias("label"), b.alias("b"), v.alias("v"), a.alias("a")) for y, b, v, a in kinds)),
                         F.pmod(F.col("id"), F.lit(len(kinds))).cast("int") + 1)
    path = pick(53, "", "src/config.py", "docs/readme.md", "web", "src3", "test/data.txt", "app/example.env")
    return (base.select(F.col("id").alias("doc_id"), parts.alias("p"), lead.alias("lead"), tail.alias("tail"), path.alias("source"))
            .select("doc_id", F.concat("lead", F.lit(" "), "p.b", "p.v", "p.a", F.lit(" "), "tail").alias("text"), "source", F.col("p.v").alias("want"), "p.label"))


def example_findings(spark: SparkSession, p: SecretScan) -> DataFrame:
    """Candidates of the example texts that are the wanted value, with their label."""
    texts = C.cut_lineage(example_texts(spark, p.examples, p.seed))
    return candidates(texts, p).join(texts.select("doc_id", "want", "label"), "doc_id").filter("value = want").drop("want")


def learnt_from() -> Column:
    """Findings whose labels may be learnt from (the others are left to measure)."""
    return F.pmod(F.xxhash64("doc", F.lit(5)), F.lit(5)) != 1


def scan(docs: DataFrame, labels=format_labels, p: SecretScan = SecretScan()) -> DataFrame:
    """Every candidate in docs(doc_id, text, source): doc, doc_id, k, start, value, label, score,
    is_secret. ``labels`` gives (doc, k, label) for candidates."""
    found = C.cut_lineage(candidates(docs, p))
    words = C.cut_lineage(dictionary(docs, p))
    ready = C.cut_lineage(covered(found, words))
    known = labels(found).groupBy("doc", "k").agg(F.max("label").alias("label"))
    marked = C.cut_lineage(ready.join(known, ["doc", "k"], "left"))
    train = marked.filter(F.col("label").isNotNull() & learnt_from())
    if p.examples:
        train = train.unionByName(covered(example_findings(docs.sparkSession, p), words))
    train = train.withColumn("digit", F.col("value").rlike("[0-9]"))
    kinds = {(r.label, r.digit): r.n for r in train.groupBy("label", "digit").agg(F.count(F.lit(1)).alias("n")).collect()}     # four rows at most
    n, ones = sum(kinds.values()), sum(label * k for (label, _), k in kinds.items())
    if not n or not ones or ones == n:
        scored = marked.withColumn("score", F.lit(0.5 if not n else float(ones or 0) / n))
    else:
        room, share = 1 << 20, p.max_labelled // len(kinds)
        taken = {k: min(1.0, share / m) for k, m in kinds.items()}
        of = {x: sum(taken[k] * m for k, m in kinds.items() if k[0] == x) for x in (0.0, 1.0)}
        bound, weight = F.lit(0), F.lit(1.0)
        for (label, digit), t in taken.items():
            here = (F.col("label") == label) & (F.col("digit") == digit)
            bound = F.when(here, F.lit(int(room * t))).otherwise(bound)
            weight = F.when(here, F.lit((of[0.0] + of[1.0]) / (2 * of[label]))).otherwise(weight)    # both labels weigh the same
        some = train.filter(F.pmod(F.xxhash64("doc", "k"), F.lit(room)) < bound).withColumn("weight", weight)
        some = C.cut_lineage(features(some, p).select("features", "label", "weight"))
        forest = RandomForestClassifier(numTrees=p.trees, maxDepth=p.depth, seed=p.seed, featureSubsetStrategy="onethird", weightCol="weight").fit(some)
        scored = forest.transform(features(marked, p)).withColumn("score", vector_to_array("probability")[1])
    return scored.select("doc", "doc_id", "k", "start", "value", "label", "score", (F.col("score") >= p.threshold).alias("is_secret"))


def redact(docs: DataFrame, labels=format_labels, p: SecretScan = SecretScan()) -> DataFrame:
    """``docs`` with the values found to be secrets replaced in ``text`` (and ``n_chars``, if it
    is there, set to the new length); all rows and columns stay."""
    bad = scan(docs, labels, p).filter("is_secret").groupBy("doc").agg(F.collect_set("k").alias("ks"))   # by text
    bad = C.cut_lineage(bad)
    text = F.col("text").cast("string")
    packed = docs.select(F.struct("*").alias("row"), text.alias("was"),                      # whatever the columns' names
                         F.xxhash64(F.col("doc_id").cast("bigint"), F.coalesce(text, F.lit(""))).alias("doc"))
    marked = C.mark_bitmap(packed, "doc", bad)
    open_ = marked.filter("_maybe").drop("_maybe").join(bad, "doc", "left")
    open_ = open_.withColumn("parts", F.when(F.col("ks").isNotNull(), _parts(F.col("was"))))
    filled = F.transform("parts", lambda v, i: F.when((i % 2 == 1) & F.array_contains("ks", F.floor(i / 2).cast("int")),
                                                      F.concat(F.regexp_extract(v, HEAD, 0), F.lit(MASK))).otherwise(v))
    new = F.array_join(filled, "")
    changed = open_.select("row", F.col("ks").isNotNull().alias("hit"), F.when(F.col("ks").isNotNull(), new).otherwise(F.col("was")).alias("now"))
    fields = {f.name: F.col("row").getField(f.name) for f in docs.schema.fields}
    kinds = dict(docs.dtypes)
    fields["text"] = F.col("now").cast(kinds["text"])
    if "n_chars" in fields:
        fields["n_chars"] = F.when(F.col("hit"), F.length("now").cast(kinds["n_chars"])).otherwise(fields["n_chars"])
    return marked.filter(~F.col("_maybe")).select("row.*").unionByName(changed.select(*(c.alias(n) for n, c in fields.items())))
