import random

from brute import components, shingles
from cases import ODD, SAMPLE, empty_documents, odd_documents, sample_rows

from runledger.llm import neardup, queries


def _want(rows, size):
    roots = components([text for _, text, *_ in rows], size)
    least = {}
    for root, (doc_id, *_) in zip(roots, rows):
        if doc_id is not None:
            least[root] = min(doc_id, least.get(root, doc_id))
    return sorted(str((r[0], len(shingles(r[1], size)), least.get(root))) for root, r in zip(roots, rows))


def _got(found):
    return sorted(str((r["doc_id"], r["n_shingles"], r["component_id"])) for r in found.collect())


def test_query_against_brute_force(spark):
    rows = sample_rows(spark)
    assert _got(queries.op6_near_duplicates(spark, SAMPLE)) == _want(rows, 4)


def test_a_group_of_near_copies(spark):
    """Copies with more and more changed words: links, chains and texts just too far apart, over many blocks."""
    random.seed(11)
    base = [f"w{random.randrange(500)}" for _ in range(60)]
    rows = []
    for k in range(250):
        words = list(base)
        for _ in range(random.randrange(0, 6)):
            words[random.randrange(60)] = f"x{random.randrange(40)}"
        rows.append((1000 - k, " ".join(words)))
    rows += [(2000 + k, " ".join(random.sample(base, 60))) for k in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert _got(neardup.near_duplicates(docs, 5)) == _want(rows, 5)


def test_small_blocks_give_the_same_links(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(63) for _ in range(40)]
    sets = [sorted({*rng.sample(base, 36), *[rng.getrandbits(63) for _ in range(3)]}) for _ in range(60)]
    ids = [bytes([k]) for k in range(60)]
    members = spark.createDataFrame([(b"a", i, i) for i in ids], "area binary, set_id binary, leader binary")
    table = spark.createDataFrame(list(zip(ids, sets)), "set_id binary, shingles array<long>")

    def groups(block):
        links = neardup.residual_links(members, table, 80, block)
        return {bytes(r["node"]): bytes(r["label"]) for r in neardup.components(neardup.stored(links, "test-links")).collect()}

    assert groups(7) == groups(512) and groups(7)


def test_odd_and_empty(spark):
    found = neardup.near_duplicates(odd_documents(spark), 5)
    assert _got(found) == _want(ODD, 5)
    assert neardup.near_duplicates(empty_documents(spark), 5).count() == 0


def test_one_document_of_each_group_stays(spark):
    kept = neardup.keep_one(odd_documents(spark), 5)
    roots = components([t for _, t, *_ in ODD], 5)
    wordless = sum(not shingles(t, 5) for _, t, *_ in ODD)
    assert kept.count() == wordless + len({r for r, (_, t, *_) in zip(roots, ODD) if shingles(t, 5)})
    assert kept.columns == odd_documents(spark).columns
