import random

import corpus_pipeline as P
from .test_repeats import brute as repeated
from .test_simhash import brute_components


def words(rng, n, tag="w"):
    return [f"{tag}{rng.randint(0, 3000)}" for _ in range(n)]


def fixture(spark, make_docs, save_tables):
    rng = random.Random(12)
    shared = " ".join(words(rng, 70, "shared"))
    items = [(i, " ".join(words(rng, 30, "item"))) for i in range(4)]
    rows, labels = [], []
    for i in range(300):
        ws = words(rng, 60)
        if i % 10 == 1:
            ws[::8] = ["nasty"] * len(ws[::8])
        if i % 10 == 2:
            ws[20:20] = shared.split(" ")
        if i in (13, 23, 33):
            ws[5:5] = items[i // 10][1].split(" ")
        rows.append((i, " ".join(ws), "en", f"src{i % 4}"))
        labels.append((i, 1, int(i % 10 == 1)))
    rows += [(400 + k, rows[5][1], "en", "src1") for k in range(3)]
    rows += [(500, None, "en", "src2"), (501, "", "en", None), (502, "tiny", "fr", "src3"), (503, " ".join(words(rng, 40_000)), "en", "src0")]
    docs = make_docs(rows)
    sf = save_tables(documents=docs, labels=spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"), benchmark=spark.createDataFrame(items, "item_id bigint, text string"))
    return rows, items, sf


def test_run_equals_the_stages_by_brute_force(spark, make_docs, save_tables):
    rows, items, sf = fixture(spark, make_docs, save_tables)
    assert [n for n, _ in P.STAGES] == ["toxicity", "simhash_near_dedup", "suffix_array_dedup", "decontamination", "mixing"]
    left = {i: t for i, t, *_ in rows if not (i < 300 and i % 10 == 1)}
    source = {r[0]: r[3] for r in rows}
    groups = brute_components(list(left.items()))
    left = {i: t for i, t in left.items() if {c for _, c in groups[i]} == {i}}
    cut = {i: "".join(c for c, m in zip(t or "", mask) if not m) for (i, t), (_, mask) in zip(left.items(), repeated(left.values(), P.REPEATED_BYTES))}
    cut = {i: t for i, t in cut.items() if t or not left[i]}
    clean = {i: t for i, t in cut.items() if not any(it in t for _, it in items)}
    assert not {13, 23, 33} & set(clean) and len(clean) > 250
    out = P.run(spark, sf).collect()
    assert P.REPEATED_BYTES == 200 and sum(len(cut[i]) < len(left[i] or "") for i in cut) >= 29  # the shared passage of 70 words
    assert {r.doc_id: r.text or "" for r in out}.items() <= clean.items()
    staged = P.cut_repeats(spark, make_docs([(i, t, "en", source[i]) for i, t in left.items()]), sf).collect()
    assert {r.doc_id: r.text or "" for r in staged} == cut
    sizes = {}
    for i, t in clean.items():
        sizes[source[i]] = sizes.get(source[i], 0) + len(t.split())
    copies = {}
    for r in out:
        copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
        assert r.source == source[r.doc_id] and (r.text is None or r.n_chars == len(r.text))
    assert max(copies.values()) <= 3
    taken = sum(len(clean[i].split()) * n for i, n in copies.items() if i != 503)
    assert taken > 0.6 * sum(len(t.split()) for i, t in clean.items() if i != 503)


def test_stages_keep_columns_and_stand_empty_tables(spark, make_docs, save_tables):
    rows, items, sf = fixture(spark, make_docs, save_tables)
    empty = make_docs(rows).limit(0)
    for _, stage in P.STAGES[:-1]:
        out = stage(spark, empty, sf)
        assert out.columns == empty.columns and out.count() == 0
    assert P.STAGES[-1][1](spark, empty, sf).columns == [*empty.columns, "copy"]


OWN_NAMES = ["row", "own", "own_id", "id", "key", "text_key", "spans", "span_id", "span_key", "content_key", "cut", "nth", "nth_copy", "keep_id", "keep_key", "bad_id", "bad_key", "fp", "component",
             "mix_id", "mix_size", "mix_src", "mix_source_size", "mix_target", "mix_rate", "mix_copies", "row_", "nth_", "spans_", "id_", "key_", "anchor", "run", "first", "last", "score", "n"]


def test_stages_stand_columns_of_every_internal_name(spark, make_docs, save_tables):
    rows, items, sf = fixture(spark, make_docs, save_tables)
    docs = make_docs(rows[:60] + rows[300:])
    wide = docs.selectExpr("*", *[f"concat('{c}-', doc_id) as {c}" for c in OWN_NAMES], "'was here' as copy")
    for name, stage in P.STAGES:
        plain, full = stage(spark, docs, sf), stage(spark, wide, sf)
        assert [c for c in full.columns if c != "copy"] == [c for c in wide.columns if c != "copy"]
        got = full.collect()
        assert sorted(map(repr, full.select(*plain.columns).collect())) == sorted(map(repr, plain.collect())), name
        assert all(r[c] == f"{c}-{r.doc_id}" for r in got for c in OWN_NAMES) and got
        assert {r.copy for r in got} <= ({"was here"} if name != "mixing" else {1, 2, 3})


def test_reused_ids_are_documents_of_their_own(spark, make_docs):
    rng = random.Random(4)
    text = {k: " ".join(words(rng, 40)) for k in "abz"}
    rows = [(1, text["a"]), (5, text["a"]), (5, text["b"]), (5, text["z"]), (5, text["z"]), (None, text["a"]), (None, "only here"), (None, "only here")]
    got = P.drop_near_duplicates(spark, make_docs(rows), "").collect()
    assert sorted((r.doc_id or 0, r.text) for r in got) == sorted([(1, text["a"]), (5, text["b"]), (5, text["z"]), (0, "only here")])
