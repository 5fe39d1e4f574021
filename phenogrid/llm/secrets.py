"""Secret scanning with a random forest against false positives.

Candidates are long runs of key characters with a digit.  Each is described
by its length, its changes between kinds of characters, how much of it a
word list covers, path marks and the words next to it.  A random forest
trained on labelled findings then drops what only looks like a secret:
hashes of commits and files, paths, identifiers, placeholders.  Only
DataFrame expressions and Spark's own forest are used.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEY_CHARS = "A-Za-z0-9+/_-"  # '=' only ends a candidate, as padding: what stands before it is a name
JWT = r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"
_END = f"(?![={KEY_CHARS}])"
# words and short numbers before '=' and a value are the value's name; possessive, so that names of any length are read in a loop
_NAME = rf"(?![A-Za-z]++(?:[_-](?:[A-Za-z]++[0-9]?+|[0-9]{{1,3}}+))*+=[\"']?[{KEY_CHARS}])"
CANDIDATE = (
    rf"(?<![{KEY_CHARS}]){_NAME}(?:{JWT}|(?=[A-Za-z+/_-]*[0-9])"
    rf"(?:[{KEY_CHARS}]{{16,}}(?:={{1,2}}{_END})?|[{KEY_CHARS}]{{15}}={_END}|[{KEY_CHARS}]{{14}}=={_END}))"
)
LEFT, RIGHT = 48, 24
LABELLED_ROWS = 8000  # bound of the training sample

DICTIONARY = (
    "access account admin alpha api app archive asset backup base beta build bundle cache client cloud code commit config core count data date default demo "
    "dev docs download event example export feature file final font group hash header icon image import index info input item java key label layer lib line "
    "list local log main manager master media member menu message meta mobile model module name network node number object option order package page part "
    "path photo plugin point post price private product project public query record release report request response result review root sample script search "
    "secret section server service session setting sign site source spec stage start state static status step style submit support system table tag target "
    "task team temp test text thumb time title token tool track type update upload user value version video view web window"
).split()
SECRET_CUES = "tokens?|secrets?|passw(?:or)?ds?|passphrase|pwd|pass|api[ _.-]?keys?|access[ _.-]?keys?|auth(?:orization)?|bearer|cred(?:ential)?s?|private[ _.-]?keys?"
HARMLESS_CUES = r"sha-?\d*|md5|commits?|checksums?|digests?|hash(?:es)?|revisions?|rev|uuid|guid|etag|integrity|versions?|builds?|examples?|samples?|dummy|placeholder|orders?|invoices?|tracking|isbn|doi|tickets?|serial"
# the last cue that is a word of its own: which kind it is, and what stands between it and the candidate
CUE = f"(?s)^.*(?<![a-z])(?:({SECRET_CUES})|({HARMLESS_CUES}))(?![a-z])(.*)$"
PREFIXES = r"^(AKIA|ASIA|ghp_|gho_|xox[abp]-|sk_live_|rk_live_|eyJ|AIza|glpat-|npm_)"

FEATURES = ("length", "digits", "uppers", "transitions", "distinct", "covered", "hex_only", "uuid", "slashes", "prefix", "path_before", "path_after", "assigned", "quoted", "secret_word", "harmless_word", "cue_gap")


def candidates(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per candidate: doc_id, start, end (code points), candidate, left and right context.

    Offsets are running sums of the lengths of candidates and of the gaps
    between them, taken over narrow rows of one document.
    """
    text = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).withColumn("hits", F.regexp_extract_all("text", F.lit(f"({CANDIDATE})"), F.lit(1)))
    text = text.where("size(hits) > 0").withColumn("row", F.monotonically_increasing_id()).withColumn("gaps", F.split("text", CANDIDATE))
    each = text.select("doc_id", "row", "hits", "gaps", F.posexplode(F.transform("hits", lambda h: h)).alias("i", "candidate"))
    each = each.select(
        "doc_id", "row", "i", "candidate",
        F.length(F.get("gaps", F.col("i"))).alias("gap"),
        # a long name with a digit is a candidate itself; it still is the context of its value
        F.expr(f"right(concat(if(get(gaps, i) like '=%', coalesce(get(hits, i - 1), ''), ''), get(gaps, i)), {LEFT})").alias("left"),
        F.expr(f"left(get(gaps, i + 1), {RIGHT})").alias("right"),
    )
    end = F.expr("sum(gap + length(candidate)) over (partition by row order by i rows between unbounded preceding and current row)")
    return each.withColumn("end", end).select("doc_id", (F.col("end") - F.length("candidate")).alias("start"), "end", "candidate", "left", "right")


def with_features(found: DataFrame) -> DataFrame:
    c = F.col("candidate")
    n = F.length(c).cast("double")

    def share(kept: str) -> Column:
        return F.length(F.regexp_replace(c, f"[^{kept}]", "")) / n

    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "[A-Z]", "U"), "[a-z]", "l"), "[0-9]", "9")
    runs = F.length(F.regexp_replace(kinds, r"(.)\1+", "$1"))
    left, right = F.coalesce("left", F.lit("")), F.coalesce("right", F.lit(""))
    flag = lambda test: test.cast("double")
    # authToken and AUTH_TOKEN are words as auth token is
    spoken = F.lower(F.regexp_replace(left, "([a-z0-9])([A-Z])", "$1 $2"))
    cue = lambda group: F.regexp_extract(spoken, CUE, group)
    made = {
        "length": n,
        "digits": share("0-9"),
        "uppers": share("A-Z"),
        "transitions": (runs - 1) / n,
        "distinct": F.size(F.array_distinct(F.split(c, ""))) / n,
        "covered": 1 - F.length(F.regexp_replace(F.lower(c), "|".join(sorted(DICTIONARY, key=len, reverse=True)), "")) / n,
        "hex_only": flag(c.rlike("^([0-9a-f]+|[0-9A-F]+)$")),
        "uuid": flag(c.rlike("^[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$")),
        "slashes": F.length(F.regexp_replace(c, "[^/]", "")).cast("double"),
        "prefix": flag(c.rlike(PREFIXES)),
        "path_before": flag(left.rlike(r"[./\\~:]$") & ~left.rlike(r"\s:$")),
        "path_after": flag(right.rlike(r"^\.[A-Za-z0-9]{1,5}\b")),
        "assigned": flag(left.rlike(r"[=:]>?\s*[\"'`]?$")),
        "quoted": flag(left.rlike("[\"'`]$") & right.rlike("^[\"'`]")),
        "secret_word": flag(cue(1) != ""),
        "harmless_word": flag(cue(2) != ""),
        "cue_gap": F.when((cue(1) != "") | (cue(2) != ""), F.length(cue(3))).otherwise(LEFT),
    }
    return found.withColumns({f: made[f].cast("double") for f in FEATURES})


def labelled_findings(spark: SparkSession, rows: int = LABELLED_ROWS) -> DataFrame:
    """A made collection of findings with a 0/1 ``label`` and its ``template``: keys in code and text against look-alikes."""
    hexes = lambda n: f"substring(sha2(concat('h', id), 512), 1, {n})"
    b64 = lambda n: f"substring(translate(base64(unhex(sha2(concat('b', id), 512))), '=', 'x'), 1, {n})"
    word = lambda i: f"element_at(words, cast(pmod(xxhash64(id, {i}), {len(DICTIONARY)}) as int) + 1)"
    prose = "element_at(array('the service uses ', 'And so it was of ', 'in the log, ', 'de la que ', 'Und die der ', '', 'see also\n'), cast(pmod(xxhash64(id, 1), 7) as int) + 1)"
    cue = "element_at(array('token', 'secret', 'api_key', 'password', 'auth_token', 'access_key', 'TOKEN', 'client_secret', 'SECRET', 'private_key'), cast(pmod(xxhash64(id, 2), 10) as int) + 1)"
    plain = "element_at(array('commit', 'sha256', 'md5', 'checksum', 'revision', 'etag', 'digest', 'build', 'integrity', 'COMMIT'), cast(pmod(xxhash64(id, 2), 10) as int) + 1)"
    named = "element_at(array('order', 'invoice', 'tracking', 'serial', 'id', 'ref', 'ticket', 'version'), cast(pmod(xxhash64(id, 2), 8) as int) + 1)"
    sign = "element_at(array(' = \"', '=\"', ': \"', '=', ': ', ' = '), cast(pmod(xxhash64(id, 3), 6) as int) + 1)"
    close = "case when right(s, 1) = '\"' then element_at(array('\"', '\" the', '\"###', '\"!! '), cast(pmod(xxhash64(id, 4), 4) as int) + 1) else ' and' end"
    size = "cast(20 + pmod(xxhash64(id, 5), 45) as int)"
    kinds = [
        (1, f"concat({prose}, {cue}, s)", hexes(40), None), (1, f"concat({prose}, {cue}, s)", hexes(size), None), (1, f"concat({prose}, {cue}, s)", f"upper({hexes(40)})", None),
        (1, f"concat({prose}, {cue}, s)", b64(size), None), (1, f"concat({prose}, s)", f"concat(element_at(array('ghp_', 'sk_live_', 'AKIA', 'glpat-', 'AIza', 'npm_'), cast(pmod(id, 6) as int) + 1), {b64(28)}, '7')", None),
        (1, f"concat({prose}, 'Authorization: Bearer ')", b64(48), "' '"),
        (0, f"concat({prose}, {plain}, element_at(array(' ', ': ', '=', ' \"'), cast(pmod(id, 4) as int) + 1))", hexes(40), "' '"), (0, f"concat({prose}, {plain}, s)", hexes(64), None),
        (0, f"concat({prose}, {named}, s)", f"concat_ws('-', substring({hexes(32)}, 1, 8), substring({hexes(32)}, 9, 4), substring({hexes(32)}, 13, 4), substring({hexes(32)}, 17, 4), substring({hexes(32)}, 21, 12))", None),
        (0, f"concat({prose}, 'https://example.com/')", f"concat({word(6)}, '/', {word(7)}, '-', {word(8)}, '/', cast(pmod(id, 100) as string), '/', {word(9)})", "'.png'"),
        (0, f"concat({prose}, {cue}, s)", f"concat('your-', {word(6)}, '-', {word(7)}, '-', {word(8)}, '-', cast(pmod(id, 1000) as string))", None),
        (0, prose, f"concat({word(6)}, '_', {word(7)}, '_', {word(8)}, '_', cast(pmod(id, 10000) as string), {word(9)})", "' '"),
        (0, f"concat({prose}, {named}, s)", "substring(conv(substring(sha2(concat('n', id), 256), 1, 15), 16, 10) || '00000000000000000', 1, 18)", None),
        (0, f"concat({cue}, s)", "repeat(element_at(array('0', '1', 'x0', '12345678', 'abc123'), cast(pmod(id, 5) as int) + 1), 20)", None),
    ]
    pick = "cast(pmod(id, {}) as int)".format(len(kinds))

    def case(part: int) -> str:
        return f"case {pick} " + " ".join(f"when {i} then {k[part] if k[part] is not None else close}" for i, k in enumerate(kinds)) + " end"

    base = spark.range(rows).withColumn("words", F.array(*map(F.lit, DICTIONARY))).withColumn("s", F.expr(sign))
    made = base.selectExpr("id", f"{pick} as template", f"{case(0)} as label", f"right({case(1)}, {LEFT}) as left", f"{case(2)} as candidate", f"left({case(3)}, {RIGHT}) as right")
    return made.where("length(candidate) >= 16")


def train(labelled: DataFrame, trees: int = 40, depth: int = 8, seed: int = 7) -> RandomForestClassificationModel:
    """A forest over ``FEATURES`` of labelled findings (candidate, left, right, label)."""
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(with_features(labelled)).select("features", F.col("label").cast("double"))
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, subsamplingRate=0.7).fit(rows)


def find_secrets(docs: DataFrame, model: RandomForestClassificationModel, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Findings that the forest keeps: doc_id, start, end, candidate, probability.

    Null and empty texts have none; texts may be of any length.  Of equal
    probabilities none is preferred: each candidate is judged for itself.
    Repeated rows are scanned each for itself, a null id is passed on, other
    columns are not read, whatever their names.  An empty table gives an
    empty one.
    """
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(with_features(candidates(docs, id_col, text_col)))
    judged = model.transform(rows).withColumn("probability", F.round(vector_to_array("probability")[1], 6))
    return judged.where(F.col("probability") >= threshold).select("doc_id", "start", "end", "candidate", "probability")
