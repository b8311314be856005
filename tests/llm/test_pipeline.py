import random
import re

import corpus_pipeline
from test_dedup import components, kept_words, template_pairs


def small(rnd):
    words = ["".join(rnd.choices("abcdeilmnorstu", k=rnd.randint(2, 8))) for _ in range(300)]
    prose = lambda n: rnd.choices(words, k=n)
    passage, base = prose(70), prose(150)
    texts = [" ".join(prose(rnd.randint(5, 120))) for _ in range(80)]
    texts += [" ".join(prose(20) + passage + prose(10)) for _ in range(4)]
    texts += [" ".join(base), "\n".join(base), None, ""]
    for _ in range(4):
        near = list(base)
        near[rnd.randrange(150)] = "edited"
        texts.append(" ".join(near))
    texts += [f"{' '.join(prose(40))} worthless {' '.join(prose(5))} pathetic" for _ in range(30)]
    return texts


def test_stages_against_brute_force(spark, tmp_path):
    texts = small(random.Random(9))
    rows = [(i, t, "en", "src", len(t or "")) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"file://{tmp_path}/documents.parquet")
    marks = [(i, 1, int("worthless" in (t or ""))) for i, t in enumerate(texts)]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    folder, now = f"file://{tmp_path}", docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r.text for r in now.collect()}
        out = stage(spark, now, folder)
        out.write.parquet(f"file://{tmp_path}/stage{k}")
        now = spark.read.parquet(f"file://{tmp_path}/stage{k}")
        if k < 4:
            assert now.columns == docs.columns
            after = {r.doc_id: r.text for r in now.collect()}
        if k == 0:
            gone = set(before) - set(after)
            assert gone == {i for i, _, toxic in marks if toxic}
        if k == 1:
            first = {}
            for i in sorted(before):
                first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", before[i] or ""), i)
            assert set(after) == set(first.values())
        if k == 2:
            assert set(after) == {i for i, (_, _, kept) in components(list(before.items()), 5, 80).items() if kept}
        if k == 3:
            cut = kept_words(list(before.items()), 50)
            assert after == {i: (" ".join(cut[i][2]) if cut[i][1] else before[i]) for i in before}
            assert any(cut[i][1] for i in cut)
    assert {r.doc_id for r in now.collect()} == set(after)
    assert corpus_pipeline.run(spark, folder).count() == now.count()


def test_near_stage_of_a_large_template_group(spark):
    texts = template_pairs(5)
    want = {i for i, (_, _, kept) in components(texts, 5, 80).items() if kept}
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    assert len(want) == 144 and {r.doc_id for r in corpus_pipeline.near_out(spark, docs, "").collect()} == want
