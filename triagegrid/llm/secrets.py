"""Secret scans with DataFrame functions only: three base patterns and a pair of character Markov models."""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from triagegrid.llm.common import materialize

# The base patterns and the characters that the Markov models know.
ASSIGN = r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
ASSIGN_MIN = 6
KINDS = ("assign", "access", "hex", "markov")
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
# A run of LEAST or more such characters; the models' ratio decides what it is.
LEAST = 8
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{8,}"

# Labelled examples of ordinary identifiers, so that the model knows some in any corpus.
ORDINARY = """
get_user_name set_default_value is_valid_email parse_config_file read_from_stream write_to_buffer update_customer_record delete_old_entries
find_first_match sort_by_date_created convert_to_string load_module_settings create_database_connection close_file_handle check_access_rights
calculate_total_price send_welcome_message build_search_index open_network_socket start_background_task stop_running_service max_retry_count
default_page_size current_working_directory environment_variable_name request_header_value response_status_code function_argument_list
some_ordinary_name another_useful_helper example_test_case product_category_page shopping_cart_items order_history_view previous_next_button
background-image-style container-fluid-wide navigation-bar-link footer-copyright-text article-main-content sidebar-left-column
""".split()


# Codes of characters from 1; 0 stands before a string's first one.
FIRST = min(map(ord, ALPHABET)) - 1
CODES = max(map(ord, ALPHABET)) - FIRST + 1
BLOCK = 64
PART = 2048
SPANS = "array<struct<start:int,kind:int,end:int,value:string>>"


class Model(NamedTuple):
    """Log-likelihood ratios random : ordinary of character pairs, by code of the first and the second, and the sum from which a run is a secret.

    missed and alarms are the shares of held-back random strings below odds and of held-back ordinary ones above it.
    """

    gains: list[float]
    odds: float
    missed: float
    alarms: float


def _let(value: Column, body) -> Column:
    """body(value), with the value computed once however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _before(values: Column, join) -> Column:
    """For each place of an array of numbers from 0 the sum (or greatest, as join says) of all before it.

    In blocks of BLOCK, then over the blocks' totals, as an array that grows by one element is copied each time.
    """
    zero = F.array(F.lit(0))
    grow = lambda a, x: F.concat(a, F.array(join(F.element_at(a, -1), x)))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / BLOCK).cast("int")), lambda k: F.aggregate(F.slice(values, k * BLOCK + 1, F.lit(BLOCK)), zero, grow))

    def place(s: Column) -> Column:
        above = F.aggregate(F.transform(s["blocks"], lambda b: F.element_at(b, -1)), zero, grow)
        at = lambda t: F.transform(s["all"], lambda _, i: join(F.get(t["above"], F.floor(i / BLOCK).cast("int")), F.get(F.get(t["blocks"], F.floor(i / BLOCK).cast("int")), i % BLOCK)))
        # Lambdas name these once; as bare expressions they would be computed for each element.
        return _let(F.struct(s["blocks"].alias("blocks"), above.alias("above")), at)

    made = _let(F.struct(values.alias("all"), blocks.alias("blocks")), place)
    return F.when(F.size(values) > 0, made).otherwise(F.array().cast("array<int>"))


def _found(text: Column, pattern: str, kind: int, group: int | None = None, least: int = 0) -> Column:
    """Array of (start, kind, end, value) of the pattern's matches, in code points, end exclusive.

    Spark gives matches and the text between them; the running sum of their
    lengths gives the places.
    """
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = whole if group is None else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    rows = F.arrays_zip(whole.alias("w"), value.alias("v"), F.split(text, pattern, -1).alias("g"))
    sizes = lambda r: F.transform(r, lambda x: F.length(x["g"]) + F.coalesce(F.length(x["w"]), F.lit(0)))

    def placed(s: Column) -> Column:
        def one(r: Column, i: Column) -> Column:
            start = F.get(s["before"], i) + F.length(r["g"])
            return F.struct(start.alias("start"), F.lit(kind).alias("kind"), (start + F.length(r["w"])).alias("end"), r["v"].alias("value"))

        return F.filter(F.transform(s["rows"], one), lambda x: F.length(x["value"]) >= least)

    made = _let(rows, lambda r: _let(F.struct(r.alias("rows"), _before(sizes(r), lambda a, b: a + b).alias("before")), placed))
    return F.when(text.rlike(pattern), made).otherwise(F.array().cast(SPANS))


def _pair_counts(df: DataFrame, col: str) -> list[tuple[int, int, int]]:
    """How often one code of ALPHABET follows another; at most len(ALPHABET)**2 rows reach the driver."""
    codes = F.transform(F.split(F.col(col), ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    pairs = df.select(codes.alias("c")).where(F.size("c") >= 2)
    pairs = pairs.select(F.explode(F.arrays_zip(F.expr("slice(c, 1, size(c) - 1)").alias("a"), F.expr("slice(c, 2, size(c) - 1)").alias("b"))).alias("p"))
    return [(r["a"], r["b"], r["n"]) for r in pairs.where((F.col("p.a") >= 0) & (F.col("p.b") >= 0)).groupBy(F.col("p.a").alias("a"), F.col("p.b").alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()]


def _log_probabilities(rows: list[tuple[int, int, int]]) -> dict[tuple[int, int], float]:
    """Of one character after another, add-half smoothed."""
    size, total, seen = len(ALPHABET), [0.0] * len(ALPHABET), {}
    for a, b, n in rows:
        total[a] += n
        seen[a, b] = seen.get((a, b), 0) + n
    return {(a, b): math.log((seen.get((a, b), 0) + 0.5) / (total[a] + 0.5 * size)) for a in range(size) for b in range(size)}


def train(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = 1500, random_strings: int = 3000, prior: float = 1e-4, alarms: float = 1e-4) -> Model:
    """Character Markov models of random strings and of ordinary identifiers, as the log-likelihood ratio of each pair of characters.

    Random strings are generated: hexadecimal, base 64 and upper-case digests of
    numbers, random_strings of each. Ordinary identifiers come from a bounded
    sample of about sample_docs documents, chosen by a hash of the id: all their
    words of letters, single, joined by _ or -, and with a number behind; and from
    the labelled examples ORDINARY, which stand alone where there are no documents.
    Both count in upper case too. Numbers, dates and rules of one character are
    generated, as no word of letters tells how ordinary they are.

    A fifth of either kind is held back. A run is a secret where the ratio says
    so against `prior`, the share of runs expected to be secrets, or from the
    quantile of held-back ordinary strings that leaves `alarms` of them above it,
    whichever is stricter.
    """
    held = F.pmod(F.xxhash64("id", F.lit(5)), F.lit(5)) == 0
    key = F.sha2(F.concat(F.lit("random"), F.col("id").cast("string")), 256)
    made = spark.range(0, random_strings, 1, 4)
    plain = F.regexp_replace(F.base64(F.unhex(key)), "=+$", "")
    random = made.select(held.alias("held"), F.explode(F.array(key, plain, F.substring(F.upper(F.regexp_replace(plain, "[+/]", "A")), 1, 20))).alias("s"))
    n = max(1, docs.count())
    part = F.pmod(F.xxhash64(F.col(id_col), F.lit(3)), F.lit(1_000_003)) < int(min(1.0, sample_docs / n) * 1_000_003)
    words = docs.where(part).select((F.pmod(F.xxhash64(F.col(id_col), F.lit(4)), F.lit(5)) == 0).alias("held"), F.regexp_extract_all(F.col(text_col), F.lit("[A-Za-z]{3,}"), F.lit(0)).alias("w"))
    tail = F.when(F.col("i") % 4 == 0, F.lit("_")).when(F.col("i") % 4 == 1, F.lit("-")).when(F.col("i") % 4 == 2, F.concat(F.pmod(F.hash("a"), F.lit(100)).cast("string"), F.lit("_"))).otherwise(F.lit(""))
    both = words.select("held", F.posexplode(F.arrays_zip(F.col("w").alias("a"), F.expr("slice(w, 2, size(w))").alias("b"))).alias("i", "p")).select("held", "i", "p.a", "p.b")
    named = both.select("held", F.concat("a", tail, F.coalesce("b", F.lit(""))).alias("s"))
    known = spark.range(0, 50, 1, 1).select(held.alias("held"), F.explode(F.array(*[F.concat(F.lit(w), F.when(F.col("id") % 3 == 0, F.col("id").cast("string")).otherwise("")) for w in ORDINARY])).alias("s"))
    named = materialize(spark, named.union(known), "secret-words")
    number = F.pmod(F.xxhash64("id"), F.lit(10**12)).cast("string")
    date = F.date_add(F.lit("1970-01-01").cast("date"), (F.col("id") * 7).cast("int")).cast("string")
    rule = F.repeat(F.substring(F.lit("-=_+/"), (F.col("id") % 5 + 1).cast("int"), F.lit(1)), 40)
    plainly = spark.range(0, 3000, 1, 4).select(held.alias("held"), F.explode(F.array(number, date, F.translate(date, "-", "/"), rule)).alias("s"))
    upper = {i: ALPHABET.index(c.upper()) for i, c in enumerate(ALPHABET)}
    counts = _pair_counts(named.where("not held"), "s")
    counts += [(upper[a], upper[b], k) for a, b, k in counts] + _pair_counts(plainly.where("not held"), "s")
    p, q = _log_probabilities(_pair_counts(random.where("not held"), "s")), _log_probabilities(counts)
    gains = [0.0] * (CODES * CODES)
    for i, a in enumerate(ALPHABET):
        for k, b in enumerate(ALPHABET):
            gains[(ord(a) - FIRST) * CODES + ord(b) - FIRST] = p[i, k] - q[i, k]
    # Held-back strings as runs: whole ordinary ones, random ones cut to 8 to 40 characters.
    ordinary = named.union(plainly).where("held").where(F.length("s") >= LEAST)
    cut = random.where("held").select(F.substring("s", F.lit(1), (F.pmod(F.hash("s"), F.lit(33)) + 8).cast("int")).alias("s"))
    score = lambda df: df.select(_ratio(F.col("s"), gains).alias("x"))
    high = score(ordinary).agg(F.percentile_approx("x", 1 - alarms, 100_000)).first()[0]
    odds = max(-math.log(prior), high if high is not None else 0.0)
    missed = score(cut).agg(F.avg((F.col("x") <= odds).cast("int"))).first()[0]
    alarm = score(ordinary).agg(F.avg((F.col("x") > odds).cast("int"))).first()[0]
    return Model(gains, odds, missed or 0.0, alarm or 0.0)


def _ratio(value: Column, gains: list[float]) -> Column:
    """Sum of the log-likelihood ratios of a string's character pairs.

    The last character's code and the sum, in steps of 1/10,000, share one number, which costs less than a row for each character.
    """
    # One text, which Spark turns into an array once, is much less to plan than a literal for each number.
    table = F.split(F.lit(",".join(str(round(x * 10_000)) for x in gains)), ",").cast("array<bigint>")
    code = lambda c: F.ascii(c) - FIRST
    step = lambda acc, c: (F.shiftright(acc, 7) + F.get(table, acc.bitwiseAND(127).cast("int") * CODES + code(c))) * 128 + code(c)
    return F.shiftright(F.aggregate(F.split(value, ""), F.lit(0).cast("bigint"), step), 7) / 10_000


def _pieces(text: Column, spans: Column, instead) -> Column:
    """The text with what spans, sorted by start, cover replaced: instead(span, reach) stands for a span before which spans reach that far.

    What stands between spans is cut from blocks of PART characters, so a span costs a block and not the text up to it.
    """

    def piece(s: Column) -> Column:
        def between(at: Column, size: Column) -> Column:
            first, last = F.floor(at / PART).cast("int"), F.floor((at + size - 1) / PART).cast("int")
            near = F.array_join(F.slice(s["blocks"], first + 1, last - first + 1), "")
            return F.when(size > 0, F.substring(near, at % PART + 1, size)).otherwise("")

        def one(x: Column, i: Column) -> Column:
            at = F.get(s["before"], i)
            return F.concat(between(at, x["start"] - at), instead(x, at))

        rest = F.substring(text, F.array_max(F.transform(s["spans"], lambda x: x["end"])) + 1, F.length(text))
        return F.concat(F.array_join(F.transform(s["spans"], one), ""), rest)

    ends = F.transform(spans, lambda x: x["end"])
    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PART}}}"), F.lit(0))
    made = _let(F.struct(spans.alias("spans"), _before(ends, lambda a, b: F.greatest(a, b)).alias("before"), blocks.alias("blocks")), piece)
    return F.when(F.size(spans) > 0, made).otherwise(text)


def scan(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), prefix: str = "") -> DataFrame:
    """Spans of secrets in every whole text: (id, *keep, base, spans).

    base and spans are arrays of (start, kind, end, value), sorted by start,
    then by kind; kind is an index into KINDS, places are code points, end
    exclusive. base has the matches of the three patterns, leftmost and
    non-overlapping for each kind. spans adds every CANDIDATE run, or the parts of
    LEAST characters or more that base spans leave of it, whose log-likelihood
    ratio exceeds the model's odds. Null and empty text have no spans; an empty
    table gives no rows; repeated rows give repeated results, whatever their ids,
    null ones too. Columns other than id, text and keep are not read; kept ones
    may not be called base or spans, which `prefix` names otherwise. Work rises in proportion to a text's length and number of spans.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    df = docs.select(F.col(id_col), *[F.col(c) for c in keep], text.alias("__text"))
    t = F.col("__text")
    base = F.concat(_found(t, ASSIGN, 0, 2, ASSIGN_MIN), _found(t, ACCESS, 1), _found(t, HEX, 2))
    base_, spans = prefix + "base", prefix + "spans"
    df = df.withColumn(base_, F.array_sort(base))
    # What base spans cover is blank, so that runs are what they leave.
    blank = _pieces(t, F.col(base_), lambda s, at: F.repeat(F.lit(" "), F.greatest(F.lit(0), s["end"] - F.greatest(s["start"], at))))
    df = df.withColumn("__view", blank)
    secret = lambda v: _ratio(v, model.gains) > model.odds
    view = F.col("__view")
    # Places are needed only where some run is a secret.
    some = F.exists(F.regexp_extract_all(view, F.lit(CANDIDATE), F.lit(0)), secret)
    more = F.when(some, F.filter(_found(view, CANDIDATE, 3), lambda s: secret(s["value"]))).otherwise(F.array().cast(SPANS))
    df = df.withColumn("__more", more)
    return df.withColumn(spans, F.when(F.size("__more") > 0, F.array_sort(F.concat(base_, "__more"))).otherwise(F.col(base_))).drop("__text", "__view", "__more")


def as_text(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column, mask: str = "[SECRET]") -> Column:
    """The text with every span replaced by the mask; spans that overlap are replaced together. Null stays null."""
    return _pieces(text, spans, lambda s, at: F.when((s["start"] >= at), F.lit(mask)).otherwise(F.lit("")))
