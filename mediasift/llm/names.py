"""Variant spellings of names typed by people.

Spellings are found token by token: what is left of a token without one or two
letters (for long tokens MinHash banding over padded q-grams, with rows and
bands read off the collision curve 1 - (1 - s^r)^b) proposes similar
tokens, and an edit distance confirms them. Records that share a token, the
most frequent spelling near one of their tokens, or a pair of near tokens, are compared by Monge-Elkan
similarity (each token of the shorter name against its best partner; initials,
shortened forms and nicknames count as partners), and star clustering makes
groups: the fullest spelling is a centre, the spellings near it its satellites.

Blocks grow finer where they are crowded: a token shared by many records is
combined with a second token, then with the organisation, so common names cost
no more than rare ones and nothing is cut off.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fold_digits, fold_marks
from ..scratch import Scratch
from ..ship import ship
from .buckets import pairs_in_buckets
from .survivors import filled_name

# Forms of address, and nicknames by full name.
TITLES = ["dr", "mr", "ms", "mrs", "miss", "prof", "sir", "herr", "frau", "mme", "mlle", "sr", "sra", "don", "dona", "ing", "jr", "phd", "md"]
NICKNAMES = {
    "alexander": "alex al sandy xander sasha lex", "anthony": "tony ant", "benjamin": "ben benny benji", "charles": "charlie chuck chas charly carl", "christine": "chris christl chrissie tina christy", "dolores": "lola loli lolita", "edward": "ed eddie ted ned teddy",
    "elisabeth": "liz lisa beth eliza betty lizzie elsa sissi lisbeth elise ella lilli liesl", "francisco": "paco pancho fran curro kiko", "frederik": "fred freddy fritz rik fredi freddie", "gabriela": "gabi gaby gabby", "ignacio": "nacho", "johanna": "hanna jo anna hanne joan", "jonathan": "jon nathan johnny", "josephine": "jo josie fina josy", "katharina": "kathi kate kathy katja rina katie kat trina", "leonard": "leo len lenny",
    "margarete": "greta gretel marge maggie meg grete margit peggy", "matthias": "matt mattes hias matze matti", "michael": "mike mick micha michi mickey", "nikolaus": "klaus nick niko nico", "patricia": "pat patty tricia trish patti", "penelope": "penny nell", "rebecca": "becky becca", "richard": "rick dick rich ricky ritchie", "robert": "bob bobby rob bert robbie", "samuel": "sam sammy", "stephanie": "steffi steph stephie", "susanne": "susi sue sanne suse susie", "theodora": "theo dora teddy thea", "valentina": "vale tina val", "veronika": "vroni nika vero ronni", "william": "bill will billy willy liam",
}
Q = 3
#: Tokens of up to SHORT letters meet under what is left of them without a letter or two. A longer token keeps most of its
#: q-grams through two edits: its Jaccard is (n - 6) / (n + 10) at least, and at this similarity two meet in some band with chance RECALL.
SHORT = 20
DESIGN_SIMILARITY, RECALL, ROWS = 0.45, 0.999, 4
#: A word is generic from this number of different words beside it in organisations, and from this part of its spellings of organisations.
GENERIC_BESIDE, GENERIC_SHARE = 12, 0.5
#: Similarities this close are no reason to prefer one person to another.
AS_NEAR = 0.03


def bands_for(similarity: float, rows: int, recall: float) -> int:
    """Bands of ``rows`` rows that catch a pair of this similarity with chance ``recall``, from the collision curve."""
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows))


def qgrams(token: str, q: int = Q) -> set[str]:
    padded = "\x01" * (q - 1) + token + "\x02" * (q - 1)
    return {padded[i : i + q] for i in range(len(padded) - q + 1)}


def signatures(tokens: list[str], n: int, seed: int = 11) -> np.ndarray:
    """MinHash signatures, one row a token."""
    rng = np.random.default_rng(seed)
    mult = rng.integers(1, 1 << 63, size=n, dtype=np.uint64) | np.uint64(1)
    add = rng.integers(0, 1 << 63, size=n, dtype=np.uint64)
    out = np.empty((len(tokens), n), dtype=np.uint64)
    for i, t in enumerate(tokens):
        grams = np.array([_gram_hash(g) for g in qgrams(t)], dtype=np.uint64)
        least = np.full(n, np.iinfo(np.uint64).max, dtype=np.uint64)
        for at in range(0, len(grams), 4096):  # a very long token needs no more memory than a short one
            x = grams[at : at + 4096, None] * mult[None, :] + add[None, :]
            x ^= x >> np.uint64(29)
            least = np.minimum(least, (x * np.uint64(0xBF58476D1CE4E5B9)).min(axis=0))
        out[i] = least
    return out


@lru_cache(1 << 16)
def _gram_hash(g: str) -> int:
    h = 1469598103934665603
    for b in g.encode():
        h = ((h ^ b) * 1099511628211) & 0xFFFFFFFFFFFFFFFF
    return h


def edits(a: str, b: str, most: int) -> int:
    """Insertions, deletions, replacements and swaps of neighbours between ``a`` and ``b``; ``most + 1`` beyond ``most``."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    if a == b:
        return 0
    far = most + 1
    before: list[int] = []
    last = [min(j, far) for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        low, high = max(1, i - most), min(len(b), i + most)
        row = [far] * (len(b) + 1) if len(b) < 64 else _Band(low - 1, high + 1, far)
        row[0 if low == 1 else low - 1] = min(i, far) if low == 1 else far
        for j in range(low, high + 1):
            y = b[j - 1]
            d = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            row[j] = min(d, far)
        before, last = last, row
    return last[len(b)]


#: Odd, so that it has an inverse modulo 2^64: taking a letter out moves what follows by one power.
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)


def deletion_keys(tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """``(place, key)``: hashes of what is left of each token without as many letters as ``allowed_edits`` grants its length, or fewer.

    Tokens within their edits of each other share one. A hash is a sum of letters times powers, so taking
    letters out needs only differences of prefix sums, for all tokens of a length at once.
    """
    places, keys = [], []
    lengths = np.array([len(t) for t in tokens], dtype=np.int64)
    with np.errstate(over="ignore"):
        for n in np.unique(lengths):
            at = np.flatnonzero(lengths == n)
            letters = np.frombuffer("".join(tokens[i] for i in at).encode("utf-32-le"), dtype=np.uint32).reshape(len(at), n).astype(np.uint64)
            letters = (letters + np.uint64(0x51ED270B)) * np.uint64(0xBF58476D1CE4E5B9)
            letters ^= letters >> np.uint64(31)
            powers = np.array([pow(_BASE, i, 1 << 64) for i in range(n)], dtype=np.uint64)
            sums = np.zeros((len(at), n + 1), dtype=np.uint64)
            np.cumsum(letters * powers, axis=1, out=sums[:, 1:])
            whole, once, twice = sums[:, -1:], np.uint64(_BACK), np.uint64(_BACK * _BACK % (1 << 64))
            out = [whole]
            most = allowed_edits("x" * n, "")
            if most >= 1:
                out.append(sums[:, :-1] + (whole - sums[:, 1:]) * once)
            if most >= 2:
                i, j = np.triu_indices(n, 1)
                out.append(sums[:, i] + (sums[:, j] - sums[:, i + 1]) * once + (whole - sums[:, j + 1]) * twice)
            key = np.concatenate(out, axis=1)
            places.append(np.repeat(at, key.shape[1]))
            keys.append(key.ravel())
    if not places:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    return np.concatenate(places), np.concatenate(keys).view(np.int64)


class _Band(dict):
    """A row of the edit table of which only a band is kept."""

    def __init__(self, low: int, high: int, far: int):
        super().__init__((j, far) for j in range(low, high + 1))
        self.far = far

    def __missing__(self, _: int) -> int:
        return self.far


def allowed_edits(a: str, b: str) -> int:
    n = max(len(a), len(b))
    return 0 if n < 4 else 1 if n < 8 else 2


@lru_cache(1)
def _nick_pairs() -> frozenset[tuple[str, str]]:
    return frozenset((full, n) for full, ns in NICKNAMES.items() for n in ns.split())


def token_similarity(a: str, b: str) -> float:
    """1 for equal tokens, less for a few edits, nicknames, shortened forms and initials, else 0."""
    if a == b:
        return 1.0
    if a > b:
        a, b = b, a
    return _unequal(a, b)


@lru_cache(1 << 18)
def _unequal(a: str, b: str) -> float:
    if "-" in a or "-" in b:  # a double name is known by either part, rather by its first
        return max((0.95 if i == j == 0 else 0.8) * token_similarity(x, y) if min(len(x), len(y)) >= 4 else 0.0 for i, x in enumerate(a.split("-")) for j, y in enumerate(b.split("-")))
    most = allowed_edits(a, b)
    if most:
        d = edits(a, b, most)
        if d <= most:
            return 1 - d / max(len(a), len(b))
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    if len(short) <= 4 and len(long) > len(short) and long.startswith(short):
        return 0.75 if len(short) == 1 else 0.85
    for full, nick in ((a, b), (b, a)):
        if (full, nick) in _nick_pairs():
            return 0.9
    if any(len(n) >= 5 and edits(n, other, 1) <= 1 for full, other in ((a, b), (b, a)) for n in NICKNAMES.get(full, "").split()):
        return 0.8
    if 3 <= len(long) and any(n == short and edits(full, long, 1) <= 1 for full, ns in NICKNAMES.items() if long[0] == full[0] or long[1:2] == full[1:2] for n in ns.split()):
        return 0.8
    return 0.0


def _is_strong(a: str, b: str) -> bool:
    if "-" in a or "-" in b:
        return any(_is_strong(x, y) for x in a.split("-") for y in b.split("-"))
    return min(len(a), len(b)) >= 4 and max(len(a), len(b)) >= 5 and edits(a, b, allowed_edits(a, b)) <= allowed_edits(a, b)


def monge_elkan(a: list[str], b: list[str]) -> tuple[float, int]:
    """Mean of the best partners of the shorter name's tokens (each used once), 0 if one has none; and the number of strong partners.

    Single letters beside two longer tokens are middle initials and do not count.
    """
    a, b = _main(a), _main(b)
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 0.0, 0
    left, total, strong = list(b), 0.0, 0
    for x in sorted(a, key=len, reverse=True):
        best = max(left, key=lambda y: token_similarity(x, y))
        s = token_similarity(x, best)
        if not s:
            return 0.0, 0
        total += s
        strong += _is_strong(x, best)
        left.remove(best)
    return total / len(a), strong


def _main(tokens: list[str]) -> list[str]:
    long = [t for t in tokens if len(t) > 1]
    return long if len(long) >= 2 else tokens


def same_org(a: list[str], b: list[str]) -> float | None:
    """Similarity of two organisations' telling tokens; None where one is missing."""
    if not a or not b:
        return None
    s, strong = monge_elkan(a, b)
    return s if strong else 0.0


def same_name(kind: str, name_a: list[str], org_a: list[str], name_b: list[str], org_b: list[str]) -> float:
    """Similarity of two records, 0 if they are different people or organisations."""
    s, strong = monge_elkan(name_a, name_b)
    if not strong:
        return 0.0
    org = same_org(org_a, org_b)
    if kind == "o" or org is None:
        alone = min(len(_main(name_a)), len(_main(name_b))) < 2
        return 0.0 if kind == "p" and alone else s
    if org == 0.0:
        return 0.0
    return (2 * s + org) / 3


def name_tokens(c: Column) -> Column:
    """Lower case words without accents; apostrophes and dots join, a hyphen makes a double name, everything else divides."""
    low = fold_marks(F.lower(fold_digits(F.coalesce(c, F.lit("")))))
    joined = F.regexp_replace(low, r"\b(mac|mc|o['’])[\s'’]*(?=\p{L}{3})", "$1")
    solid = F.regexp_replace(joined, r"(?<=\p{L})\.(?=\p{L}\b)|['’]", "")
    double = F.regexp_replace(solid, r"(?<=\p{L}{2})[-\u2010\u2011](?=\p{L}{2})", "\u0001")
    return F.filter(F.transform(F.split(double, r"[^\p{L}\p{Nd}\x01]+"), lambda x: F.translate(x, "\u0001", "-")), lambda x: (x != "") & ~x.isin(TITLES))


def word_parts(tokens: Column) -> Column:
    """The tokens with double names taken apart."""
    return F.array_distinct(F.flatten(F.transform(tokens, lambda x: F.split(x, "-"))))


def similar_tokens(vocabulary: DataFrame, scratch: Scratch) -> DataFrame:
    """``(token, near)`` both ways for the tokens of ``vocabulary`` (column ``token``, distinct) that are spellings of each other.

    Buckets of deletion keys hold what is left plus one or two letters, so the alphabet bounds them, not the rows.
    """
    bands = bands_for(DESIGN_SIMILARITY, ROWS, RECALL)

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 2000):
                tokens, items = list(pdf["token"][at : at + 2000]), pdf["item"].to_numpy()[at : at + 2000]
                # Two of different ways differ by two letters at most: up to SHORT + 2 both have deletions, from SHORT + 1 on both have bands.
                brief = np.array([len(t) <= SHORT + 2 for t in tokens])
                place, key = deletion_keys([t for t in tokens if len(t) <= SHORT + 2])
                yield pd.DataFrame({"bucket": key, "item": items[brief][place]})
                long = np.array([len(t) > SHORT for t in tokens])
                rows = signatures([t for t in tokens if len(t) > SHORT], bands * ROWS).reshape(int(long.sum()), bands, ROWS)
                key = np.tile(np.arange(1, bands + 1, dtype=np.uint64), (len(rows), 1))
                for r in range(ROWS):
                    key = (key ^ rows[:, :, r]) * np.uint64(0x9E3779B97F4A7C15)
                yield pd.DataFrame({"bucket": key.view(np.int64).ravel(), "item": np.repeat(items[long], bands)})

    numbered = scratch.write(vocabulary.where(F.length("token") >= 4).select("token", F.monotonically_increasing_id().alias("item")))
    parallel = max(numbered.rdd.getNumPartitions(), numbered.sparkSession.sparkContext.defaultParallelism)
    keyed = numbered.repartition(parallel, "item").mapInPandas(sign, "bucket bigint, item bigint")
    met = scratch.write(pairs_in_buckets(keyed, lambda x, y: x != y).distinct())
    spelt = lambda i, t: numbered.select(F.col("item").alias(i), F.col("token").alias(t))
    # Every swap of neighbours is two single edits, so 2 * allowed is a safe first test inside the JVM.
    longest = F.greatest(F.length("x"), F.length("y"))
    allowed = F.when(longest < 8, 1).otherwise(2)
    likely = met.join(spelt("a", "x"), "a").join(spelt("b", "y"), "b").where((F.abs(F.length("x") - F.length("y")) <= allowed) & (F.levenshtein("x", "y") <= 2 * allowed))

    @F.pandas_udf("boolean")
    def close(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([edits(p, q, allowed_edits(p, q)) <= allowed_edits(p, q) for p, q in zip(x, y, strict=True)], dtype=bool)

    sure = F.levenshtein("x", "y") <= allowed  # without a swap the JVM can tell
    pairs = likely.where(sure).select("x", "y").unionByName(likely.where(~sure).where(close("x", "y")).select("x", "y"))
    return pairs.select(F.explode(F.array(F.struct(F.col("x").alias("token"), F.col("y").alias("near")), F.struct(F.col("y").alias("token"), F.col("x").alias("near")))).alias("p")).select("p.*")


def _usual_spelling(counts: DataFrame, near: DataFrame) -> DataFrame:
    """``(token, usual)``: the most frequent token near each token, itself if it is that."""
    rank = lambda n, t: F.struct(n, t)
    other = counts.select(F.col("token").alias("near"), F.col("n").alias("m"))
    best = near.join(other, "near").groupBy("token").agg(F.max(rank("m", "near")).alias("best"))
    return counts.join(best, "token", "left").select("token", F.when(F.col("best") > rank("n", "token"), F.col("best")["near"]).otherwise(F.col("token")).alias("usual"))


def _block_keys(near: DataFrame, usual: DataFrame) -> DataFrame:
    """``(token, key)``: itself, its usual spelling, and one key for each token near it that shares neither; so any two near tokens have a key in common."""
    own = usual.select("token", F.explode(F.array_distinct(F.array("token", "usual"))).alias("key"))
    x, y = (usual.select(F.col("token").alias(t), F.col("usual").alias(f"usual_{t}")) for t in ("token", "near"))
    apart = near.join(x, "token").join(y, "near").where((F.col("usual_token") != F.col("usual_near")) & (F.col("usual_token") != F.col("near")) & (F.col("usual_near") != F.col("token")))
    return own.unionByName(apart.select("token", F.concat_ws("|", F.least("token", "near"), F.greatest("token", "near")).alias("key")))


def _records(contacts: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Records ``(id, kind, name, org)`` as token arrays, the tokens near each other, and their usual spelling."""
    stated = contacts.where("id IS NOT NULL").select("id", *[name_tokens(filled_name(F.col(c))).alias(c) for c in ("given", "family", "organization")])
    parts = scratch.write(stated.select("id", "given", "family", F.concat("given", "family").alias("person"), F.col("organization").alias("org")).distinct())
    tokens = parts.select(F.explode(word_parts(F.concat("person", "org"))).alias("token"))
    counts = scratch.write(tokens.groupBy("token").agg(F.count("*").alias("n")))
    near = scratch.write(similar_tokens(counts, scratch))
    usual = scratch.write(_usual_spelling(counts, near))

    # Words that go with many different words in organisations tell nothing of which one it is. Spellings of
    # organisations count, not contacts, so that copies of one change nothing; names of people typed as
    # organisations go with many words too, but are at home in the other fields.
    told = lambda c: parts.where(F.size(c) > 0).select(F.array_sort(F.array_distinct(c)).alias("words")).distinct()
    words = told("org").select(F.xxhash64("words").alias("key"), F.explode("words").alias("token")).join(usual, "token").select("key", "usual").distinct()
    words = scratch.write(words)
    beside = words.join(words.select("key", F.col("usual").alias("other")), "key").where("usual <> other").groupBy("usual").agg(F.approx_count_distinct("other", 0.03).alias("beside"))
    uses = words.groupBy("usual").agg(F.count("*").alias("uses"))
    people = told("person").select(F.explode("words").alias("token")).join(usual, "token").groupBy("usual").agg(F.count("*").alias("people"))
    of_many = (F.col("beside") >= GENERIC_BESIDE) & (F.col("beside") >= GENERIC_SHARE * F.col("uses")) & (F.col("uses") >= F.coalesce("people", F.lit(0)))
    generic = scratch.write(uses.join(beside, "usual").join(people, "usual", "left").where(of_many).select("usual"))
    plain = scratch.write(usual.join(generic, "usual").select("token"))

    flat = parts.select("id", F.explode_outer(F.concat(F.transform("given", lambda t: F.struct(F.lit("g").alias("f"), t.alias("token"))), F.transform("family", lambda t: F.struct(F.lit("f").alias("f"), t.alias("token"))), F.transform("org", lambda t: F.struct(F.lit("o").alias("f"), t.alias("token"))))).alias("x"))
    marked = flat.select("id", "x.f", "x.token").join(plain.withColumn("plain", F.lit(True)), "token", "left")
    # A shortened generic word ("svcs", "mfg") keeps its first letter and the order of the others. Tokens are
    # looked up once each, by their first two letters in order, so that no letter gathers the tokens of all organisations.
    pair = lambda c, i: F.concat(F.substring(c, 1, 1), i)
    letters = lambda c: F.array_distinct(F.split(F.substring(c, 2, 1 << 20), ""))
    longer = plain.where(F.length("token") >= 7).select(F.col("token").alias("longer"), F.explode(letters("token")).alias("l")).where("l <> ''").select("longer", pair(F.col("longer"), F.col("l")).alias("start"))
    brief = marked.where("f = 'o'").select("token").where(F.length("token").between(2, 6)).distinct().select("token", F.substring("token", 1, 2).alias("start"))
    kept = brief.join(longer, "start").where(F.rlike("longer", F.concat(F.lit("^"), F.regexp_replace("token", "(.)", "$1.*")))).select("token").distinct()
    initials = marked.where("f = 'o'").select("token").where(F.length("token") == 1).distinct().join(plain.where(F.length("token") >= 7).select(F.substring("token", 1, 1).alias("token")).distinct(), "token")
    marked = marked.join(kept.unionByName(initials).withColumn("short", F.lit(True)), "token", "left")
    short = F.coalesce("short", F.lit(False))
    marked = marked.withColumn("plain", F.coalesce("plain", F.lit(False))).withColumn("short", (F.col("f") == "o") & short)
    of = lambda f, keep: F.filter(F.collect_list(F.when((F.col("f") == f) & keep, F.col("token"))), lambda x: x.isNotNull())
    any_ = lambda f, what: F.max((F.col("f") == f) & what)
    rows = marked.groupBy("id").agg(
        of("g", F.lit(True)).alias("g"), of("f", F.lit(True)).alias("fam"), of("o", F.lit(True)).alias("o"), of("g", ~F.col("plain")).alias("g_core"), of("f", ~F.col("plain")).alias("fam_core"), of("o", ~F.col("plain") & ~F.col("short")).alias("core"),
        F.coalesce(any_("o", F.col("plain")), F.lit(False)).alias("o_generic"), F.coalesce(any_("f", F.col("plain")), F.lit(False)).alias("f_generic"),
    )
    none = F.array().cast("array<string>")
    empty = lambda c: F.size(c) == 0
    org_typed_as_family = empty("g_core") & empty("o") & F.col("f_generic")
    org_typed_over_both = ~empty("g_core") & ~empty("fam") & empty("o") & empty("fam_core")
    person_typed_as_org = empty("g") & empty("fam") & ~F.col("o_generic") & (F.size("o") >= 2)
    org_only = empty("g") & empty("fam") & ~person_typed_as_org
    name = F.when(org_typed_over_both, F.col("g")).when(org_typed_as_family, F.col("fam_core")).when(person_typed_as_org, F.col("o")).when(org_only, F.col("core")).otherwise(F.concat("g", "fam"))
    org = F.when(org_typed_over_both | org_typed_as_family | person_typed_as_org | org_only, none).otherwise(F.col("core"))
    kind = F.when(org_typed_over_both | org_typed_as_family | org_only, "o").otherwise("p")
    records = rows.select("id", kind.alias("kind"), F.array_sort(F.array_distinct(name)).alias("name"), F.array_sort(F.array_distinct(org)).alias("org")).where(F.size("name") > 0)
    return scratch.write(records), near, usual


def _candidates(spellings: DataFrame, near: DataFrame, usual: DataFrame, scratch: Scratch) -> DataFrame:
    """``(a, b)``, ``a < b``: every two spellings that :func:`same_name` can accept.

    Names of two tokens or more match only if one token is a spelling of a token of the other and a second token
    has a partner too; if both state an organisation, these must share a spelling as well. So records meet on
    two tokens at once, and on the organisation where both have one: no block is larger than what it lets match, and none is cut.
    A name of one token meets every spelling of it, people those of their organisation.
    """
    spelt = scratch.write(_block_keys(near, usual))
    # As in the comparison, single letters beside two longer tokens are middle initials.
    main = F.filter("name", lambda x: F.length(x) > 1)
    main = F.when(F.size(main) >= 2, main).otherwise(F.col("name"))
    told = spellings.select("rep", "kind", main.alias("main"), (F.size("org") > 0).alias("placed"))
    flat = told.select("rep", "kind", "placed", F.size("main").alias("n"), F.posexplode("main").alias("pos", "whole")).select("rep", "kind", "placed", "n", "pos", F.explode(F.split("whole", "-")).alias("token"))
    flat = scratch.write(flat.where(F.length("token") > 0))
    orgs = scratch.write(spellings.select("rep", F.explode(word_parts(F.col("org"))).alias("token")).join(spelt.withColumnRenamed("key", "o"), "token").select("rep", "o").distinct())

    first = flat.where(F.length("token") >= 4).join(spelt.withColumnRenamed("key", "t"), "token").select("rep", "kind", "placed", "n", "pos", "t").distinct()
    first = scratch.write(first)
    # Partners of a token: its spellings; the names it may be short for; what it begins with (2) or, if brief itself, what begins with it (1).
    brief = flat.where(F.length("token") <= 4).select("token").distinct()
    begins = F.explode(F.transform(F.sequence(F.lit(1), F.least(F.lit(4), F.length("token") - 1)), lambda i: F.substring(F.col("token"), F.lit(1), i)))
    words = scratch.write(flat.select("token").distinct())
    heads = words.where(F.length("token") > 1).select("token", begins.alias("head")).join(brief.withColumnRenamed("token", "head"), "head").select("token", F.concat(F.lit("#"), "head").alias("u"), F.lit(2).alias("side"))
    own = words.where(F.length("token") <= 4).select("token", F.concat(F.lit("#"), "token").alias("u"), F.lit(1).alias("side"))
    spelled = spelt.join(words, "token").select("token", F.col("key").alias("u"), F.lit(0).alias("side"))
    partners = scratch.write(spelled.unionByName(_nicknames(words).select("token", "u", F.lit(0).alias("side"))).unionByName(heads).unionByName(own))
    second = flat.where("n >= 2").join(partners, "token").select("rep", F.col("pos").alias("pos_u"), "u", "side")
    two = first.where("n >= 2").join(second, "rep").where("pos <> pos_u")
    # Two spellings at once are the same in either order.
    plain = (F.col("side") == 0) & (F.col("t") > F.col("u"))
    two = two.select("rep", "placed", F.concat_ws("\x1f", "kind", F.when(plain, F.col("u")).otherwise(F.col("t")), F.when(plain, F.col("t")).otherwise(F.col("u"))).alias("k"), "side").distinct()
    two = scratch.write(two)
    inside = scratch.write(two.where("placed").join(orgs, "rep").select("rep", F.concat_ws("\x1e", "k", "o").alias("k"), "side"))

    free, all_ = two.where("NOT placed"), two
    out = [_meet(inside.where("side = 0"), inside.where("side = 0"), True), _meet(free.where("side = 0"), all_.where("side = 0"))]
    out += [_meet(inside.where("side = 1"), inside.where("side > 0")), _meet(free.where("side = 1"), all_.where("side > 0")), _meet(all_.where("side = 1"), free.where("side = 2"))]
    lone = first.where("n = 1")
    out.append(_meet(lone.where("kind = 'o'").withColumnRenamed("t", "k"), first.where("kind = 'o'").withColumnRenamed("t", "k")))
    at_work = lambda rows: rows.where("kind = 'p'").join(orgs, "rep").select("rep", F.concat_ws("\x1e", "t", "o").alias("k"))
    out.append(_meet(at_work(lone), at_work(first)))
    pairs = out[0]
    for more in out[1:]:
        pairs = pairs.unionByName(more)
    return pairs.distinct()


def _meet(left: DataFrame, right: DataFrame, same: bool = False) -> DataFrame:
    """``(a, b)``, ``a < b``: rows of two sides under the same key ``k``; ``same`` where both sides are one table."""
    # The planner takes exploded keys for no larger than what they come from; the hint keeps it from broadcasting them.
    met = left.select("k", F.col("rep").alias("x")).hint("merge").join(right.select("k", F.col("rep").alias("y")), "k").where("x < y" if same else "x <> y")
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def _nicknames(words: DataFrame) -> DataFrame:
    """``(token, u)``: one key for each full name that a token is a nickname of, or a spelling of within one edit."""
    spark = words.sparkSession
    known = spark.createDataFrame([(full, n) for full, ns in NICKNAMES.items() for n in ns.split()], "full string, nick string")
    full = F.broadcast(known.select("full").distinct())  # as long as the fixed list
    spelled = words.join(full, (F.abs(F.length("token") - F.length("full")) <= 1) & (F.levenshtein("token", "full") <= 2)).select("token", "full")
    typed = (F.col("token") == F.col("nick")) | (F.length("nick") >= 5) & (F.abs(F.length("token") - F.length("nick")) <= 1) & (F.levenshtein("token", "nick") <= 2)
    nicks = words.join(F.broadcast(known), typed).select("token", "full")
    return spelled.unionByName(nicks).distinct().select("token", F.concat(F.lit("="), "full").alias("u"))


def star_clusters(vertices: DataFrame, edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``(v, centre)``. ``vertices`` has ``v`` and a distinct ``rank``; ``edges`` has ``a, b, similarity``, each pair once.

    The same stars as taking vertices by falling rank, each one not yet covered
    becoming a centre that covers its neighbours; done in rounds in which every vertex that
    outranks all its uncovered neighbours becomes a centre. A satellite joins its most similar centre.
    """
    ranks = vertices.select("v", "rank")
    both = edges.select("a", "b", "similarity").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "similarity"))
    links = scratch.write(both.join(ranks.select(F.col("v").alias("a"), F.col("rank").alias("rank_a")), "a").join(ranks.select(F.col("v").alias("b"), F.col("rank").alias("rank_b")), "b"))
    live, centres, shaded = links, None, None
    while not live.isEmpty():
        top = scratch.write(live.groupBy("a").agg(F.max(F.col("rank_a")).alias("own"), F.max("rank_b").alias("best")).where("own > best").select(F.col("a").alias("v")))
        centres = top if centres is None else centres.unionByName(top)
        covered = scratch.write(live.join(top.withColumnRenamed("v", "a"), "a", "left_semi").select(F.col("b").alias("v")).unionByName(top).distinct())
        shaded = covered if shaded is None else shaded.unionByName(covered)
        rest = live.join(covered.withColumnRenamed("v", "a"), "a", "left_anti").join(covered.withColumnRenamed("v", "b"), "b", "left_anti")
        live = scratch.write(rest)
    if centres is None:
        return vertices.select("v", F.col("v").alias("centre"))
    alone = vertices.join(links.select(F.col("a").alias("v")).distinct(), "v", "left_anti").select("v")
    # A vertex whose neighbours were all covered by others is a centre too.
    left = links.select(F.col("a").alias("v")).distinct().join(shaded, "v", "left_anti")
    centres = scratch.write(centres.unionByName(left))
    near = links.join(centres.withColumnRenamed("v", "b"), "b", "left_semi").join(centres.withColumnRenamed("v", "a"), "a", "left_anti")
    satellites = near.groupBy("a").agg(F.max(F.struct("similarity", "rank_b", "b")).alias("m")).select(F.col("a").alias("v"), F.col("m.b").alias("centre"))
    return satellites.unionByName(centres.unionByName(alone).select("v", F.col("v").alias("centre")))


def link_names(contacts: DataFrame) -> DataFrame:
    """``(id, group_id)`` for every contact that names a person or an organisation: ``group_id`` is the contact of the fullest spelling.

    People match if each part of the shorter name has a partner in the other
    and at least one is a spelling of four letters or more; if both name an
    organisation, those must match too, a missing part is no difference. Contacts that name nobody
    (nulls, blanks, stand-ins) have no row, rows of one contact that differ count as spellings of it; a name without
    organisation that fits people of several organisations joins none of them; an empty table gives no rows.
    """
    ship(contacts.sparkSession)
    scratch = Scratch(contacts.sparkSession, "names")
    records, near, usual = _records(contacts, scratch)
    spellings = scratch.write(records.groupBy("kind", "name", "org").agg(F.min("id").alias("rep"), F.count("*").alias("n")))
    pairs = scratch.write(_candidates(spellings, near, usual, scratch))

    side = lambda x: spellings.select(F.col("rep").alias(x), F.col("kind").alias(f"kind_{x}"), F.col("name").alias(f"name_{x}"), F.col("org").alias(f"org_{x}"))
    full = pairs.join(side("a"), "a").join(side("b"), "b").where("kind_a = kind_b")

    @F.pandas_udf("double")
    def compare(kind: pd.Series, na: pd.Series, oa: pd.Series, nb: pd.Series, ob: pd.Series) -> pd.Series:
        return pd.Series([same_name(k, list(a), list(o), list(b), list(p)) for k, a, o, b, p in zip(kind, na, oa, nb, ob, strict=True)], dtype="float64")

    scored = scratch.write(full.select("a", "b", F.col("kind_a").alias("kind"), (F.size("org_a") > 0).alias("has_a"), (F.size("org_b") > 0).alias("has_b"), compare("kind_a", "name_a", "org_a", "name_b", "org_b").alias("similarity")).where("similarity > 0"))
    degree = scored.select(F.explode(F.array("a", "b")).alias("v")).groupBy("v").agg(F.count("*").alias("d"))
    letters = F.aggregate("name", F.lit(0), lambda acc, x: acc + F.length(x))
    shortest = F.array_min(F.transform("name", F.length))
    rank = F.struct((shortest > 3).alias("r1"), F.coalesce("d", F.lit(0)).alias("r2"), F.col("n").alias("r3"), letters.alias("r4"), F.col("rep").alias("r5"))
    vertices = scratch.write(spellings.join(degree.withColumnRenamed("v", "rep"), "rep", "left").select(F.col("rep").alias("v"), ((F.size("org") > 0) | (F.col("kind") == "o")).alias("placed"), rank.alias("rank")))

    # First the spellings that name an organisation (or are one), then those that leave it out: these join the
    # only person they fit best, and where they fit people of several organisations as well they keep to themselves.
    placed = star_clusters(vertices.where("placed"), scored.where("kind = 'o' OR has_a AND has_b"), scratch)
    employer = spellings.select(F.col("rep").alias("centre"), F.explode("org").alias("token")).join(usual, "token").groupBy("centre").agg(F.min("usual").alias("employer"))
    loose = scored.where("kind = 'p' AND has_a <> has_b").select(F.when(F.col("has_a"), F.col("b")).otherwise(F.col("a")).alias("v"), F.when(F.col("has_a"), F.col("a")).otherwise(F.col("b")).alias("other"), "similarity")
    apart = scored.where("kind = 'p' AND NOT has_a AND NOT has_b").select(F.explode(F.array("a", "b")).alias("v"), "similarity")
    nearest = loose.select("v", "similarity").unionByName(apart).groupBy("v").agg((F.max("similarity") - AS_NEAR).alias("least"))
    fits = loose.join(nearest, "v").where(F.col("similarity") >= F.col("least")).join(placed.withColumnRenamed("v", "other"), "other").join(employer, "centre", "left")
    joined = scratch.write(fits.groupBy("v").agg(F.min("employer").alias("e1"), F.max("employer").alias("e2"), F.max(F.struct("similarity", "centre")).alias("m")).where("e1 = e2").select("v", F.col("m.centre").alias("centre")))
    rest = scratch.write(vertices.where("NOT placed").join(joined, "v", "left_anti"))
    among = scored.where("kind = 'p' AND NOT has_a AND NOT has_b").join(rest.select(F.col("v").alias("a")), "a", "left_semi").join(rest.select(F.col("v").alias("b")), "b", "left_semi")
    stars = placed.unionByName(joined).unionByName(star_clusters(rest, among, scratch))
    return scratch.write(records.join(spellings.select("kind", "name", "org", "rep"), ["kind", "name", "org"]).select("id", F.col("rep").alias("v")).join(stars, "v").select("id", F.col("centre").alias("group_id")).distinct())


def name_pairs(contacts: DataFrame, groups: DataFrame) -> DataFrame:
    """``(id_a, id_b)``, ``id_a < id_b``: contacts outside ``groups`` that mean the same person or organisation."""
    taken = groups.select(F.explode("member_ids").alias("id")).distinct()
    linked = link_names(contacts.join(taken, "id", "left_anti"))
    a, b = linked.withColumnRenamed("id", "id_a"), linked.withColumnRenamed("id", "id_b")
    return a.join(b, "group_id").where("id_a < id_b").select("id_a", "id_b").distinct()
