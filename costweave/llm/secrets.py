"""Secret scans: three fixed patterns, and random strings found by character Markov models. DataFrame operations only.

Two first-order character models, of random strings and of ordinary identifiers, are compared by log-likelihood ratio
over every run of MARKOV_LEAST or more token characters that touches no pattern match. A model has two chains: of
character classes (lower, upper, digit, mark) and of letters regardless of case, so that a few labelled identifiers tell
much. The ratio is taken as a mean over the run's steps; MARKOV_MEAN + MARKOV_SPREAD / sqrt(steps) or more is a span of
kind markov, so short runs need to be clearer than long ones.

Each model is a mixture of two labelled samples: written ones (IDENTIFIERS; strings of RANDOM_STRINGS drawn
evenly from usual alphabets) and ones of the corpus: values that the patterns matched (random) and longer words
(ordinary), from at most RANDOM_DOCS and ORDINARY_DOCS documents drawn by hash. What reaches the driver is a table of
character pairs, whose size is fixed by the alphabet.

Offsets are code points, end exclusive. A match's place follows from the lengths of the pieces between matches, summed
in blocks, so a very long text with many matches takes nearly linear time. Null text is empty; rows repeat as they come,
ties can't occur (spans differ in start or kind); other columns are kept or not looked at, whatever their names; an
empty table gives an empty result.
"""

from __future__ import annotations

import json
import math
import random
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "markov")
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 8  # characters of the value
# a run of 16 characters or more with the prefix, and whole runs of 32 or more: shorter matches would be dropped
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{32,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/=_-"
_RUN = r"(?<![A-Za-z0-9+/=_-])[A-Za-z0-9+/=_-]"
#: Runs of the corpus that count as ordinary: words of letters, which a random string hardly is.
WORD = r"(?<![A-Za-z0-9+/=_-])[A-Z]?[a-z]{7,}(?![A-Za-z0-9+/=_-])"
MARKOV_LEAST, MARKOV_MEAN, MARKOV_SPREAD = 20, 0.2, 1.6
RANDOM_DOCS, ORDINARY_DOCS, RANDOM_STRINGS = 20_000, 2_000, 3_000
FIRM = 20_000  # steps from which on a sample of the corpus counts half as much as the written one, or more
CUT = 4096  # characters of a block of text
BLOCK = 256  # array elements summed together
_NONE = "array<struct<start:bigint,kind:int,end:bigint,value:string>>"

#: Labelled sample of ordinary identifiers, names, paths and dates, written for this model.
IDENTIFIERS = """
customerAccountBalance calculateMonthlyInterest HttpRequestHandlerFactory AbstractMessageListenerContainer getUserProfileById
setDefaultCharacterEncoding OrderShippingAddressValidator isValidEmailAddress convertTemperatureToCelsius parseConfigurationFile
DatabaseConnectionPoolManager InvalidArgumentException removeExpiredSessionEntries DocumentBuilderFactory ReadWriteLockInterface
max_connections_per_host default_retry_interval_seconds user_login_attempt_counter number_of_worker_threads last_modified_timestamp
created_by_user_id shipping_address_line_one monthly_revenue_report enable_experimental_features database_migration_version
MAX_BUFFER_SIZE_BYTES DEFAULT_TIMEOUT_MILLISECONDS ERROR_FILE_NOT_FOUND LOG_LEVEL_WARNING HTTP_STATUS_UNAUTHORIZED
my-first-blog-post-about-gardening how-to-bake-sourdough-bread top-10-places-to-visit-in-2019 data-toggle-dropdown-menu btn-primary-outline-large
content-security-policy-report-only x-forwarded-for-header application/vnd-openxmlformats text/html/charset-utf-8 multipart/form-data
src/main/java/com/example/service/OrderService docs/guides/getting-started/installation usr/local/share/applications home/projects/website/assets/images
lib/python/site-packages/requests/adapters static/images/products/thumbnails api/v2/customers/orders/latest var/log/nginx/access tests/unit/test_parser
2021-03-15T10-45-30 2018/12/31/year-in-review 1999-2005-annual-report 00000000000000000001 12345678901234567890 1-800-555-0199-0000
------------------------------ ============================== ______________________________ aaaaaaaaaaaaaaaaaaaaaaaa
InternationalizationSupport telecommunications counterrevolutionaries electroencephalogram Donaudampfschifffahrtsgesellschaft
Rechtsschutzversicherungsgesellschaften anticonstitutionnellement responsabilidades desafortunadamente Geschwindigkeitsbegrenzung
TransactionIsolationLevel SimpleBeanDefinitionReader ConcurrentHashMapEntryIterator addPropertyChangeListener onActivityResultReceived
fetchNextPageOfResults updateShoppingCartTotals renderTemplateWithContext serializeObjectToJson compressImageThumbnail
queue_consumer_group_offset image_processing_pipeline_stage payment_gateway_response_code search_index_rebuild_job user_preferences_cache_key
kubernetes-ingress-controller docker-compose-production-override terraform-aws-provider-module continuous-integration-workflow react-native-navigation-stack
part_number_00012345 invoice-2020-000123 chapter-04-section-12 ISO-8859-1-encoding UTF-8-byte-order-mark Version-10-0-19041 model_checkpoint_epoch_120
FirstNameLastNameEmail BackgroundColorAnimation MouseEventDispatcherThread WindowResizeObserver KeyboardShortcutRegistry
""".split()


def _let(value: Column, then) -> Column:
    """``then(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), then), 0)


def _before(values: Column, combine) -> Column:
    """For each of the (non-negative) values, all that come before it combined; arrays are built block by block."""
    zero = F.lit(0).cast("long")
    put = lambda acc, v: F.struct(combine(acc["at"], v).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
    start = lambda at: F.struct(at.alias("at"), F.array().cast("array<bigint>").alias("out"))

    def blocks(v: Column) -> Column:
        cut = F.sequence(F.lit(0), F.floor((F.size(v) - 1) / BLOCK).cast("int"))
        held = F.transform(cut, lambda b: F.slice(v, b * BLOCK + 1, BLOCK))
        return _let(held, lambda held: F.flatten(F.transform(F.arrays_zip(held.alias("held"), F.aggregate(F.transform(held, lambda h: F.aggregate(h, zero, lambda a, b: combine(a, b))), start(zero), put, lambda acc: acc["out"]).alias("at")), lambda x: F.aggregate(x["held"], start(x["at"]), put, lambda acc: acc["out"]))))

    return _let(values, lambda v: F.when(F.size(v) > 0, blocks(v)).otherwise(F.array().cast("array<bigint>")))


def _matches(text: Column, pattern: str, kind: int, value_group: int = 0) -> Column:
    """Spans of all leftmost non-overlapping matches."""
    columns = {"found": F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), "between": F.split(text, pattern, -1)}
    if value_group:
        columns["value"] = F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group))

    def spans(zipped: Column) -> Column:
        sizes = F.transform(zipped, lambda m: (F.length(m["between"]) + F.length(m["found"])).cast("long"))
        placed = F.arrays_zip(zipped.alias("m"), _before(sizes, lambda a, b: a + b).alias("at"))
        start = lambda p: p["at"] + F.length(p["m"]["between"])
        return F.transform(placed, lambda p: F.struct(start(p).alias("start"), F.lit(kind).alias("kind"), (start(p) + F.length(p["m"]["found"])).alias("end"), p["m"]["value" if value_group else "found"].alias("value")))

    # zipped once, so that no step of the sum matches again; behind the last match there is one piece more
    return _let(F.filter(F.arrays_zip(*(c.alias(k) for k, c in columns.items())), lambda m: m["found"].isNotNull()), spans)


def base_spans(text: Column) -> Column:
    """Spans (start, kind, end, value) of the three patterns. What a match must contain is looked for first."""
    none = F.array().cast(_NONE)
    assign = F.filter(_matches(text, ASSIGN, 0, 2), lambda s: F.length(s["value"]) >= ASSIGN_LEAST)
    return F.concat(
        F.when((F.contains(text, F.lit("=")) | F.contains(text, F.lit(":"))) & text.rlike(ASSIGN), assign).otherwise(none),
        F.when(F.contains(text, F.lit("AKIA")), _matches(text, ACCESS, 1)).otherwise(none),
        F.when(text.rlike(HEX), _matches(text, HEX, 2)).otherwise(none),
    )


def _apart(runs: Column, base: Column) -> Column:
    """Those of the runs, which don't overlap one another, that touch no base span."""
    late = F.lit(2**40)

    def keep(spans: Column) -> Column:
        ends = _before(F.transform(spans, lambda s: F.when(s["kind"] < 3, s["end"]).otherwise(0)), F.greatest)
        # from behind: how far before ``late`` the base spans that follow begin
        back = F.reverse(_before(F.reverse(F.transform(spans, lambda s: F.when(s["kind"] < 3, late - s["start"]).otherwise(0))), F.greatest))
        zipped = F.arrays_zip(spans.alias("s"), ends.alias("ended"), back.alias("back"))
        free = F.filter(zipped, lambda z: (z["s"]["kind"] == 3) & (z["ended"] <= z["s"]["start"]) & (late - z["back"] >= z["s"]["end"]))
        return F.transform(free, lambda z: z["s"])

    return _let(runs, lambda own: F.when((F.size(base) > 0) & (F.size(own) > 0), _let(F.array_sort(F.concat(base, own)), keep)).otherwise(own))


def _kind(place: int) -> int:
    """Class of a character of ALPHABET by its place from 1: upper, lower, digit, mark; 4 for others."""
    return 4 if not place else 0 if place <= 26 else 1 if place <= 52 else 2 if place <= 62 else 3


class Chains:
    """Class and letter transitions of one labelled sample."""

    def __init__(self, pairs: dict[tuple[int, int], float]):
        self.kinds, self.letters = [[0.0] * 5 for _ in range(5)], [[0.0] * 26 for _ in range(26)]
        self.steps = sum(pairs.values())
        for (a, b), n in pairs.items():
            self.kinds[_kind(a)][_kind(b)] += n
            if 0 < a <= 52 and 0 < b <= 52:
                self.letters[(a - 1) % 26][(b - 1) % 26] += n

    def chance(self, a: int, b: int) -> tuple[float, float]:
        kinds, letters = self.kinds[_kind(a)], self.letters[(a - 1) % 26]
        return (kinds[_kind(b)] + 0.5) / (sum(kinds) + 2.5), (letters[(b - 1) % 26] + 0.5) / (sum(letters) + 13)


def _written(strings: list[str]) -> Chains:
    return Chains(Counter((ALPHABET.find(a) + 1, ALPHABET.find(b) + 1) for x in strings for a, b in zip(x, x[1:])))


def _random_strings() -> list[str]:
    """Labelled sample of random strings over usual alphabets, the same every time."""
    draw = random.Random(3)
    kinds = (ALPHABET[:62], ALPHABET[:64], ALPHABET[:26] + ALPHABET[52:62], ALPHABET[26:62], ALPHABET[52:62] + "abcdef", ALPHABET[:62] + "_-")
    return ["".join(draw.choices(kinds[i % len(kinds)], k=32)) for i in range(RANDOM_STRINGS)]


def train(docs: DataFrame) -> list[int]:
    """Thousandths of the log-likelihood ratio of each character given the one before, as a flat table; index 0 is any other character."""
    text = F.coalesce("text", F.lit(""))
    draw = F.xxhash64("doc_id", F.lit(3))
    drawn = docs.select("doc_id").where("doc_id is not null").distinct().orderBy(draw, "doc_id").limit(RANDOM_DOCS)
    ordinary = drawn.orderBy(draw, "doc_id").limit(ORDINARY_DOCS).select(F.col("doc_id").alias("other"))
    drawn = F.broadcast(drawn.join(ordinary, F.col("doc_id") == F.col("other"), "left").select(F.col("doc_id").alias("drawn"), F.col("other").isNotNull().alias("both")))
    rows = docs.join(drawn, F.col("doc_id") == F.col("drawn")).select("both", text.alias("text"))
    rows = rows.select("both", "text", base_spans(F.col("text")).alias("base"))
    runs = _apart(_matches(F.col("text"), WORD, 3), F.col("base"))
    labelled = rows.select(F.lit("random").alias("label"), F.explode("base.value").alias("value")).union(rows.where("both").select(F.lit("ordinary"), F.explode(runs["value"])))
    steps = _let(_places(F.col("value")), lambda p: F.arrays_zip(F.slice(p, 1, F.size(p) - 1).alias("a"), F.slice(p, 2, F.size(p) - 1).alias("b")))
    pairs = labelled.where(F.length("value") > 1).select("label", F.inline(steps))
    counts = pairs.groupBy("label", "a", "b").count().collect()
    found = {label: Chains({(a, b): n for own, a, b, n in counts if own == label}) for label in ("random", "ordinary")}
    return ratios((_written(_random_strings()), found["random"]), (_written(IDENTIFIERS), found["ordinary"]))


def ratios(randoms: tuple[Chains, Chains], ordinaries: tuple[Chains, Chains]) -> list[int]:
    """The flat table of two models, each a mixture of a written sample and one of the corpus, which counts less if small."""
    width, table = len(ALPHABET) + 1, []
    mix = lambda written, corpus, a, b, i: (written.chance(a, b)[i] + (w := corpus.steps / (corpus.steps + FIRM)) * corpus.chance(a, b)[i]) / (1 + w)
    for a in range(width):
        for b in range(width):
            r, o = ([mix(*samples, a, b, i) for i in (0, 1)] for samples in (randoms, ordinaries))
            letters = math.log(r[1] / o[1]) if 0 < a <= 52 and 0 < b <= 52 else 0.0
            table.append(round(1000 * (math.log(r[0] / o[0]) + letters)))
    return table


def is_random(value: Column, model: list[int]) -> Column:
    """Whether a run's mean log-likelihood ratio reaches the cut for its length."""
    width, table = len(ALPHABET) + 1, F.from_json(F.lit(json.dumps(model)), "array<int>")
    steps = F.length(value) - 1
    zero = F.struct(F.lit(None).cast("int").alias("last"), F.lit(0).cast("long").alias("total"))
    step = lambda acc, p: F.struct(p.alias("last"), (acc["total"] + F.coalesce(F.get(table, acc["last"] * width + p), F.lit(0))).alias("total"))
    total = F.aggregate(_places(value), zero, step, lambda acc: acc["total"])
    return total >= F.ceil(1000 * (MARKOV_MEAN * steps + MARKOV_SPREAD * F.sqrt(steps)))


def find(docs: DataFrame, model: list[int]) -> DataFrame:
    """``docs`` with ``secret_base`` and ``secret_spans``: arrays of (start, kind, end, value), sorted."""
    text = F.coalesce("text", F.lit(""))
    pattern = _RUN + f"{{{MARKOV_LEAST},}}"
    out = docs.withColumn("secret_base", F.array_sort(base_spans(text)))
    more = F.filter(_apart(_matches(text, pattern, 3), F.col("secret_base")), lambda s: is_random(s["value"], model))
    more = F.when(text.rlike(pattern), more).otherwise(F.array().cast(_NONE))
    return out.withColumn("secret_spans", F.array_sort(F.concat("secret_base", more)))


def _places(value: Column) -> Column:
    """Each character's place in ALPHABET, from 1; 0 for others."""
    return F.transform(F.filter(F.split(value, ""), lambda c: c != ""), lambda c: F.call_function("locate", c, F.lit(ALPHABET)))


def listed(spans: str) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of every row."""
    found = find(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), train(docs))
    of = lambda k: F.size(F.filter("secret_base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return found.select("doc_id", *(of(k) for k in range(3)), F.sha2(listed("secret_base"), 256).alias("base_sha256"), listed("secret_spans").alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span (overlapping ones together) replaced by <secret>, and n_chars to match."""
    text = F.coalesce("text", F.lit(""))

    # blocks of characters, so that a piece is cut out without a walk from the text's beginning
    cut = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CUT}}}"), F.lit(0))

    def part(blocks: Column, start: Column, end: Column) -> Column:
        first = F.floor(start / CUT).cast("int")
        joined = F.array_join(F.slice(blocks, first + 1, F.floor((end - 1) / CUT).cast("int") - first + 1), "")
        return F.when(end > start, F.substring(joined, (start - first * CUT + 1).cast("int"), (end - start).cast("int"))).otherwise("")

    def pieces(blocks: Column, placed: Column) -> Column:
        gaps = F.filter(placed, lambda p: p["s"]["start"] >= p["at"])
        kept = F.transform(gaps, lambda p: part(blocks, p["at"], p["s"]["start"]))
        rest = part(blocks, F.array_max(F.transform(placed, lambda p: p["s"]["end"])), F.length(text).cast("long"))
        return F.array_join(F.concat(kept, F.array(rest)), "<secret>")

    spans = F.col("secret_spans")
    clean = _let(cut, lambda blocks: _let(F.arrays_zip(spans.alias("s"), _before(spans["end"], F.greatest).alias("at")), lambda placed: pieces(blocks, placed)))
    names = docs.columns
    rows = find(docs.select(F.struct("*").alias("row"), "text"), train(docs))
    hit = F.size("secret_spans") > 0
    fixed = {"text": F.when(hit, clean).otherwise(F.col("text"))}
    if "n_chars" in names:
        fixed["n_chars"] = F.when(hit, F.length(clean).cast("long")).otherwise(F.col("row.n_chars"))
    return rows.select(*(fixed.get(c, F.col(f"row.`{c}`")).alias(c) for c in names))
