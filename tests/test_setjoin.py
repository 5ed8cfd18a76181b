"""The set-similarity join, title candidates and the image join against brute force; the work where one word is in half of all titles."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from bazaarlake.operators import hashjoin, resolution, setjoin


def brute(rows, threshold):
    sets = [(k, {t for t in ts or () if t is not None}) for k, ts in rows if k is not None]
    out = Counter()
    for i, (a, x) in enumerate(sets):
        for b, y in sets[i + 1 :]:
            if x and y and len(x & y) >= threshold * len(x | y) - 1e-12:
                out[(min(a, b), max(a, b), round(len(x & y) / len(x | y), 9))] += 1
    return out


@pytest.mark.parametrize(("threshold", "block_rows"), [(0.3, 4000), (0.5, 5), (0.8, 5)])
def test_pairs_equal_brute_force(spark, monkeypatch, threshold, block_rows):
    monkeypatch.setattr(setjoin, "BLOCK_ROWS", block_rows)
    rng = random.Random(4)
    words = ["the"] * 6 + [f"w{k}" for k in range(25)]
    rows = [(k, [rng.choice(words) for _ in range(rng.randint(0, 7))]) for k in range(150)] + [(900, None), (901, [None, "the"]), (902, ["the", "the"]), (None, ["the"])]
    got = setjoin.similar_pairs(spark.createDataFrame(rows, "key long, tokens array<string>"), threshold)
    assert Counter((r.low_key, r.high_key, round(r.jaccard, 9)) for r in got.collect()) == brute(rows, threshold)


def test_a_frequent_word_brings_few_pairs(spark):
    rng = random.Random(5)
    rows = [(k, ["the"] * (k % 2) + [f"w{rng.randrange(3000)}" for _ in range(6)]) for k in range(1200)]
    sets = setjoin.prefixes(setjoin.named_sets(spark.createDataFrame(rows, "key long, tokens array<string>")).select("set_id", "tokens"), 0.6)
    pairs_of_the = 600 * 599 // 2
    assert setjoin.to_verify(sets, 0.6).count() < pairs_of_the / 100


def test_threshold_bounds(spark):
    with pytest.raises(ValueError):
        setjoin.similar_pairs(spark.createDataFrame([], "key long, tokens array<string>"), 0)


WORDS = ["usb", "hub", "wireless", "bluetooth", "charger", "red", "redder", "case", "phone", "smartphone", "x100", "steel", "type-c"]


def catalog(spark, n, seed):
    rng = random.Random(seed)
    title = lambda: " ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 5)))
    listings = [(k, title(), "acme" if k % 3 else None) for k in range(n)]
    products = [(k, title(), "acme steel", {"kind": rng.choice(WORDS), "none": None}, rng.choice(WORDS), "tools/" + rng.choice(WORDS)) for k in range(n)] + [(999, None, None, None, None, None)]
    a = resolution.complete(spark.createDataFrame(listings, "id long, title string, brand string"), "id")
    b = resolution.complete(spark.createDataFrame(products, "product_id long, title string, brand string, specs map<string,string>, title_raw string, path string"), "product_id")
    return a, b


def test_title_candidates_equal_brute_force(spark):
    a, b = catalog(spark, 60, 6)
    wanted = {r.id: r.wanted for r in resolution.wanted_words(a).collect()}
    words = {r.product_id: set(r.words) for r in b.select("product_id", "words").collect()}
    split = lambda alt: alt.replace("-", " ").split()
    does = lambda alt, own: any(w.startswith(alt) for w in own) if len(split(alt)) == 1 else set(split(alt)) <= own
    want = {(i, p) for i, concepts in wanted.items() for p, own in words.items() if all(any(does(alt, own) for alt in do) for do in concepts)}
    got = [(r.id, r.product_id) for r in resolution.title_candidates(a, b).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 50


def test_candidates_meet_at_the_rarest_word(spark):
    """A word in half of the products' titles brings no pairs where the listing has a rarer one."""
    products = spark.range(2000).select(F.col("id").alias("product_id"), F.concat(F.lit("wireless "), F.when(F.col("id") % 2 == 0, F.lit("gadget ")).otherwise(""), F.lit("m"), "id").alias("title"))
    listings = spark.range(100).select("id", F.concat(F.lit("wireless gadget m"), F.col("id") * 20).alias("title"))
    a, b = resolution.complete(listings, "id"), resolution.complete(products, "product_id")
    assert resolution.title_pairs(a, b).count() < 2000
    assert {r.id for r in resolution.title_candidates(a, b).collect()} == set(range(100))


@pytest.mark.parametrize("distance", [0, 2, 3, 9, 18, 21])
def test_hashes_within_a_distance_equal_brute_force(spark, distance):
    rng = random.Random(distance)
    flip = lambda h, n: h ^ sum(1 << b for b in rng.sample(range(64), n))
    signed = lambda h: h - 2**64 if h >= 2**63 else h
    seeds = [rng.getrandbits(64) for _ in range(12)]
    hashes = [0, 2**64 - 1, *seeds, *(flip(rng.choice(seeds), rng.randint(0, 24)) for _ in range(120))]
    rows = [(k, signed(h)) for k, h in enumerate(hashes)] + [(500, signed(seeds[0])), (501, None)]
    got = Counter(tuple(r) for r in hashjoin.pairs_within(spark.createDataFrame(rows, "image_id long, phash long"), distance).collect())
    known = [(k, h & (2**64 - 1)) for k, h in rows if h is not None]
    assert got == Counter((i, j, d) for i, x in known for j, y in known if i < j and (d := bin(x ^ y).count("1")) <= distance)


def test_far_hashes_meet_in_several_tasks(spark, monkeypatch):
    """Small inputs too: the blocks of a wide distance aren't led into one task; both sides differ, and a block is compared in stripes and tiles."""
    monkeypatch.setattr(hashjoin, "TILE", 100)
    hashes = spark.range(3000).select(F.xxhash64("id").alias("phash"))
    wanted = hashes.filter("phash % 5 = 0")
    known, some = ([r.phash & (2**64 - 1) for r in side.collect()] for side in (hashes, wanted))
    near = hashjoin.near_hashes(wanted, hashes, 20)
    assert near.rdd.getNumPartitions() >= 8
    assert Counter((r.x & (2**64 - 1), r.y & (2**64 - 1), r.distance) for r in near.collect()) == Counter((x, y, d) for x in some for y in known if (d := (x ^ y).bit_count()) <= 20)
    half = hashjoin.near_hashes(hashes, None, 14)
    assert half.rdd.getNumPartitions() >= 8 and half.filter("x > y").isEmpty()
    assert half.count() == sum((x ^ y).bit_count() <= 14 for k, x in enumerate(known) for y in known[k:])


@pytest.mark.parametrize("distance", [0, 3, 10, 11])
def test_hashes_meet_by_bands_without_a_filter_of_all_masks_a_value(spark, distance):
    """Small distances go by bands and equal brute force; the masks are made once, not filtered from 65,536 anew for each value."""
    rng = random.Random(9)
    flip = lambda h, n: h ^ sum(1 << b for b in rng.sample(range(63), n))
    first = [rng.getrandbits(63) for _ in range(40)]
    other = [flip(h, n) for h in first for n in (0, 1, 3, 4, 9, 10, 11, 12)]
    frames = [spark.createDataFrame([(h,) for h in hashes], "phash long") for hashes in (first, other)]
    near = hashjoin.near_hashes(*frames, distance)
    want = {(x, y, d) for x in first for y in other if (d := (x ^ y).bit_count()) <= distance}
    assert Counter(map(tuple, near.collect())) == Counter(want)
    assert "sequence" not in hashjoin.neighbours(*(hashjoin.banded(f, distance) for f in frames), distance)._jdf.queryExecution().toString()
