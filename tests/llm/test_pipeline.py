import random
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline as cp  # noqa: E402

from docquery.llm.common import WORDS  # noqa: E402
from docquery.llm.pieces import lattice, load  # noqa: E402
from docquery.llm.private_data import find_spans  # noqa: E402
from test_language_id import DE, EN  # noqa: E402
from test_mixing import filled  # noqa: E402


def corpus():
    rng = random.Random(9)
    rows = []
    for i in range(150):
        lang, words = rng.choice([("en", EN), ("de", DE)])
        rows.append((i, " ".join(rng.choices(words, k=rng.randrange(20, 90))), lang, rng.choice(["s0", "s0", "s0", "s1", None])))
    for i in range(20):
        rows.append((200 + i, rows[i][1] + " more", rows[i][2], rows[i][3]))
    rows += [(300, None, "en", "s1"), (301, "12345 !!", "en", "s1"), (302, "", None, None), (303, EN[0] + " a@b.cd +1 (017) 555-7713 " + " ".join(EN), "en", "s1"), (5, rows[5][1], "de", "s0")]
    return [(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in rows]


def grams(text):
    w = WORDS.findall(text.lower())
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}


def test_stages_against_plain_python(spark, tmp_path):
    rows = corpus()
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(path)
    docs = [spark.read.parquet(path)]
    for k, (_, stage) in enumerate(cp.STAGES):
        out = stage(spark, docs[-1], str(tmp_path))
        assert k == len(cp.STAGES) - 1 or out.columns == docs[0].columns
        out.write.parquet(str(tmp_path / f"out{k}"))
        docs.append(spark.read.parquet(str(tmp_path / f"out{k}")))
    named, single, clean, mixed, coded = (sorted(map(tuple, d.collect()), key=repr) for d in docs[1:])

    assert named == sorted((r for r in rows if r[1] and any(c.isalpha() for c in r[1])), key=repr)

    left = sorted(named)
    kept = []
    roots = list(range(len(left)))
    for i in range(len(left)):
        for j in range(i):
            a, b = grams(left[i][1]), grams(left[j][1])
            if 5 * len(a & b) >= 4 * len(a | b):
                old, new = roots[i], roots[j]
                roots = [new if r == old else r for r in roots]
    for r in set(roots):
        kept.append(min(left[i] for i in range(len(left)) if roots[i] == r))
    assert single == sorted(kept, key=repr) and len(single) < len(named) - 15

    assert [r[0] for r in clean] == [r[0] for r in single]
    assert all(not find_spans(r[1]) and r[4] == len(r[1]) for r in clean)
    assert any("[email] [phone]" in r[1] for r in clean)

    sizes = {}
    for r in clean:
        sizes[r[3]] = sizes.get(r[3], 0) + len(WORDS.findall(r[1]))
    order = sorted(s for s in sizes if s is not None) + [None]
    want = filled(sizes, {s: i % 3 + 1 for i, s in enumerate(order)}, 3)
    assert set(mixed) <= set(clean)
    for s in sizes:
        assert abs(sum(len(WORDS.findall(r[1])) for r in mixed if r[3] == s) - want[s]) <= 50

    lat = lattice(load())
    assert sorted((i, lat.decode(ids)) for i, _, _, ids in coded) == sorted((r[0], r[1]) for r in mixed)
    assert all(n == len(ids) for _, n, _, ids in coded)

    assert sorted(map(tuple, cp.run(spark, str(tmp_path)).collect()), key=repr) == coded


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    assert cp.run(spark, str(tmp_path)).collect() == []


def test_pieces_are_the_three_best(spark):
    docs = spark.createDataFrame([(1, " ".join(EN)), (2, None)], "doc_id long, text string")
    whole, none = cp.pieces(spark, docs, "").orderBy("doc_id").collect()
    lat = lattice(load())
    assert len(whole.segmentations) == 3 and len({tuple(s.ids) for s in whole.segmentations}) == 3
    assert all(lat.decode(s.ids) == " ".join(EN) for s in whole.segmentations)
    assert [s.score for s in whole.segmentations] == sorted((s.score for s in whole.segmentations), reverse=True)
    assert whole.ids == whole.segmentations[0].ids and whole.n_pieces == len(whole.ids)
    assert none.n_pieces == 0 and none.ids == []
