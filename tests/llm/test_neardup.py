import random
import re

from llm_data import SHAPE, awkward_rows, edited, opposite_words, prose

from loomspark.llm.neardup import near_dedup, near_duplicates, op3_minhash_neardup


def shingles(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def brute(rows, n, percent):
    sets = [shingles(r[1], n) for r in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                    parent[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return sorted(((r[0], len(s), least.get(find(i)) if s else r[0]) for i, (r, s) in enumerate(zip(rows, sets, strict=True))), key=str)


def got(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=str)


def test_groups_of_drifting_copies_match_brute_force(spark):
    """Copies at every distance from their original, chains of copies, exact copies, and unrelated texts."""
    rows, at = [], 0
    draw = random.Random(4)

    def add(text):
        nonlocal at
        at += 1
        rows.append((at * 7 % 4001, text, "en", "a", 1))

    for g in range(2):
        base = prose(g, 150)
        for i in range(80):
            add(edited(base, 1000 * g + i, draw.choice([0.0, 0.01, 0.02, 0.04, 0.08, 0.15])))
        chain = base
        for i in range(15):
            chain = edited(chain, 5000 + 100 * g + i, 0.03)
            add(chain)
        for i in range(30):
            add(" ".join(base.split()[: 150 - 3 * i]))
            add(" ".join(prose(9_000 + i, 3 * i).split() + base.split()))
    for i in range(60):
        add(prose(20_000 + i, 60))
    df = spark.createDataFrame(rows, SHAPE)
    assert got(near_duplicates(df, 3, 85)) == brute(rows, 3, 85)
    kept = {r.doc_id for r in near_dedup(df).collect()}
    assert kept == {c for _, _, c in brute(rows, 5, 80)}


def test_awkward_rows(spark, awkward):
    found = op3_minhash_neardup(spark, awkward)
    assert got(found) == brute(awkward_rows(), 3, 85)
    assert all(r.kept == (r.doc_id == r.component_id) for r in found.collect())


def test_dedup_keeps_columns_and_one_of_each_group(spark, awkward):
    docs = spark.read.parquet(f"{awkward}/documents.parquet")
    kept = near_dedup(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()).count("1") == 1


def test_empty(spark, empty):
    assert op3_minhash_neardup(spark, empty).count() == 0


def test_chains_of_drifting_versions_match_brute_force(spark):
    """Each version is an edit of the one before: members of one chain are settled by different pivots."""
    rows, wanted = [], []
    for c in range(25, 45):
        text, own = prose(c, 200), []
        for i in range(30):
            own.append((100 * c + i, text, "en", "a", 1))
            text = edited(text, 1000 * c + i, 0.022)
        rows += own
        wanted += brute(own, 3, 85)
    found = got(near_duplicates(spark.createDataFrame(rows, SHAPE), 3, 85))
    assert found == sorted(wanted, key=str)


def test_words_that_weak_hashes_confuse(spark):
    a, b = opposite_words()
    rows = [(1, f"{a} q r", "en", "a", 1), (2, f"{b} q r", "en", "a", 1), (3, f"{a} q r", "en", "a", 1)]
    assert got(near_duplicates(spark.createDataFrame(rows, SHAPE), 3, 85)) == brute(rows, 3, 85)


def test_copies_of_edited_copies_match_brute_force(spark):
    """One text, variants of it beyond the threshold, and many copies of each: popular differences, few of them links."""
    rows, base = [], prose(77, 120)
    for v in range(6):
        variant = edited(base, v, 0.2 * (v > 0))
        rows += [(1000 * v + i, edited(variant, 100 * v + i, (0.0, 0.01, 0.04, 0.07)[i % 4]), "en", "a", 1) for i in range(60)]
    for percent, words in ((85, 3), (80, 5)):
        assert got(near_duplicates(spark.createDataFrame(rows, SHAPE), words, percent)) == brute(rows, words, percent)


def test_recall_of_all_pairs_of_driver_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    component = {r.doc_id: r.component_id for r in op3_minhash_neardup(spark, "/root/testdata/sf0.01").collect()}
    sets = {r.doc_id: s for r in docs.select("doc_id", "text").collect() if (s := shingles(r.text, 3))}
    holders = {}
    for d, s in sets.items():
        for t in sorted(s, key=hash)[: len(s) - -(-85 * len(s) // 100) + 1]:  # one order of all shingles: a linked pair shares one of these
            holders.setdefault(t, []).append(d)
    pairs = {(x, y) for own in holders.values() for x in own for y in own if x < y}
    linked = [(x, y) for x, y in pairs if 100 * (both := len(sets[x] & sets[y])) >= 85 * (len(sets[x]) + len(sets[y]) - both)]
    found = sum(component[x] == component[y] for x, y in linked)
    print(f"recall: {found} of {len(linked)} linked pairs")
    assert len(linked) > 100 and found >= 0.9 * len(linked)


def test_one_of_rows_repeated_in_whole_stays(spark):
    rows = [(5, prose(1, 60), "en", "a", 1)] * 3 + [(6, prose(1, 60), "en", "a", 1), (7, prose(2, 60), "en", "a", 1), (8, None, "en", "a", 1), (8, None, "en", "a", 1)]
    assert sorted(r.doc_id for r in near_dedup(spark.createDataFrame(rows, SHAPE)).collect()) == [5, 7, 8]
