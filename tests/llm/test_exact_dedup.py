import hashlib
import random
from collections import defaultdict

import pytest

from topicweave.llm import exact_dedup as X
from topicweave.llm.queries import QUERIES


def brute(rows):
    """(id, text) -> sorted (id, keep_id, group_size, kept, sha)."""
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    out = []
    for t, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = max(known) if known else None
        sha = hashlib.sha256(t.encode()).hexdigest()
        first = ids.index(keep)
        out += [(i, keep, len(ids), k == first, sha) for k, i in enumerate(ids)]
    return sorted(out, key=repr)


def corpus(rng, n):
    base = ["".join(rng.choice("ab é日") for _ in range(rng.randint(0, 60))) for _ in range(n // 3)]
    texts = [rng.choice(base) + rng.choice(["", "", "x", " "]) for _ in range(n)]
    return list(enumerate(texts + ["", None, " ", "a\0b", "a", "ab", "z" * 200_000, "z" * 200_000 + "y", "z" * 200_000]))


@pytest.mark.parametrize("trie_bytes,local_bytes,part_bytes", [(1 << 27, 1 << 25, 1 << 26), (4000, 3000, 1 << 26), (1500, 500, 2000)])
def test_equals_brute_force(make_docs, trie_bytes, local_bytes, part_bytes):
    rows = corpus(random.Random(trie_bytes), 400)
    docs = make_docs(rows, parts=4).selectExpr("*", "1 as uid", "2 as hash", "3 as sha", "4 as id", "5 as ids")
    got = X.exact_groups(docs, trie_bytes=trie_bytes, local_bytes=local_bytes, part_bytes=part_bytes).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(rows)


def test_a_spill_takes_more_than_one_round(make_docs, monkeypatch):
    rounds, real = [], X._insert_round
    monkeypatch.setattr(X, "_insert_round", lambda rows, *a: rounds.append(rows.count()) or real(rows, *a))
    rows = corpus(random.Random(5), 300)
    got = X.exact_groups(make_docs(rows), trie_bytes=2000, part_bytes=1 << 30).collect()
    assert len(rounds) > 1 and rounds[1] < rounds[0]
    assert sorted((tuple(r) for r in got), key=repr) == brute(rows)


def test_reused_and_null_ids_keep_one_row_of_each_text(make_docs):
    rows = [(1, "a"), (1, "a"), (1, "b"), (None, "a"), (None, "c"), (None, "c"), (2, None), (3, "")]
    got = X.exact_groups(make_docs(rows)).collect()
    assert sorted((r.id, r.keep_id, r.group_size, r.kept) for r in got if r.id is not None) == [(1, 1, 1, True), (1, 1, 3, False), (1, 1, 3, True), (2, 3, 2, False), (3, 3, 2, True)]
    assert sorted(r.kept for r in got if r.keep_id is None) == [False, True]
    assert sum(r.kept for r in got) == 4


def test_empty_table_and_all_columns_back(make_docs, spark):
    empty = make_docs([]).limit(0)
    assert X.exact_groups(empty).columns == ["id", "keep_id", "group_size", "kept", "sha"]
    assert X.exact_groups(empty).count() == 0
    docs = make_docs([(1, "a"), (2, "a"), (2, "a"), (3, "b")]).selectExpr("*", "'q' as doc", "1 as nth", "2 as own_id", "3 as stay_sha")
    kept = X.owners_only(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r.text, r.doc) for r in kept.collect()) == [(2, "a", "q"), (3, "b", "q")]


def test_trie_against_a_dictionary():
    rng = random.Random(9)
    trie, want = X.PatriciaTrie(), {}
    for _ in range(3000):
        s = bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 30)))
        node = trie.reach(s)
        node.held = {"uids": (node.held or {"uids": []})["uids"] + [1]}
        want[s] = want.get(s, 0) + 1
    assert {s: len(n.held["uids"]) for s, n in trie.walk()} == want


def test_shared_bytes_against_a_loop():
    rng = random.Random(4)
    for _ in range(500):
        a = bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 3))) * 40
        b = bytearray(a[: rng.randint(0, len(a))])
        if b and rng.random() < 0.7:
            b[rng.randrange(len(b))] ^= 1
        at = 0
        want = next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
        assert X.shared_bytes(a, at, bytes(b)) == want


def test_query_over_the_whole_table(spark):
    got = QUERIES["op13_exact_dedup"](spark, "/root/testdata/sf0.001").collect()
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got), key=repr) == brute(rows)
