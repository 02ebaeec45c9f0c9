"""Which texts the language stage keeps."""
import zlib

import numpy as np
import pytest

import corpus_pipeline
from roundscope.llm import string_kernel

FOREIGN = [
    "Съешь же ещё этих мягких французских булок, да выпей чаю", "我能吞下玻璃而不伤身体", "我", "Ξεσκεπάζω την ψυχοφθόρα βδελυγμία", "أنا قادر على أكل الزجاج و هذا لا يؤلمني",
    "Mogę jeść szkło i mi nie szkodzi, wszyscy ludzie rodzą się wolni i równi w swojej godności i prawach", "xkcd qwrtp bvcxz zxcvb lkjhg mnbvc pqrst wrtgh",
    "Tất cả mọi người sinh ra đều được tự do và bình đẳng về nhân phẩm và quyền",
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet").cache()


def test_languages_not_taught_go(make, docs):
    model = string_kernel.train(docs)
    foreign = [(i, t) for i, t in enumerate(FOREIGN)]
    assert string_kernel.keep_identified(make(foreign), model).count() == 0
    alone = [i for i, (n, s) in enumerate(zip(*model.predict(FOREIGN), strict=True)) if s == 0]
    assert {0, 1, 2, 3, 4} <= set(alone)  # other scripts share blanks only


def test_clean_texts_stay(make, spark, docs):
    """Whole held-out texts and their clauses of three and ten words."""
    held = [r for r in docs.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0 and any(c.isalpha() for c in r.text or "")]
    model = string_kernel.train(docs)
    for words in (3, 10, 10**6):
        some = [(r.doc_id, " ".join(r.text.split()[:words])) for r in held]
        some = [x for x in some if any(c.isalpha() for c in x[1])]
        assert string_kernel.keep_identified(make(some), model).count() >= 0.99 * len(some)
    assert corpus_pipeline.identify_language(spark, docs, "").count() >= 0.99 * docs.count()


def test_overlap_leaves_blanks_out():
    kernel = string_kernel.Kernel(["ab", "ac"])
    total, known = kernel.overlap(string_kernel.grams("жж", kernel.letters)[0])
    assert (total, known) == (7, 0) and kernel.overlap(string_kernel.grams("ab", kernel.letters)[0], 2)[1] == 2
    assert np.isclose(kernel.values(["ab"])[0][0, 0], 1)
