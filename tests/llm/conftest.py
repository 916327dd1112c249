import pytest
from pyspark.sql import types as T

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    """A table of documents from (doc_id, text) pairs, with columns whose names clash with results."""

    def make(rows):
        schema = T.StructType.fromDDL(DOCS + ", n long, text_sha256 string, fp long, dg string, score double, print long, keep_id long, kept string")
        full = []
        for r in rows:
            doc_id, text, *rest = r
            lang, source = [*rest, None, None][:2]
            full.append((doc_id, text, lang, source, None, 1, "x", 2, "y", 0.5, 3, 4, "z"))
        return spark.createDataFrame(full, schema)

    return make


def random_texts(seed=5, n=60, vocab=40, most=120):
    """Prose with shared passages, copies and near copies."""
    import random

    draw = random.Random(seed)
    words = ["".join(draw.choice("abcdeé") for _ in range(draw.randint(2, 7))) for _ in range(vocab * 20)]
    passage = [draw.choice(words) for _ in range(60)]
    out = []
    for _ in range(n):
        own = [draw.choice(words) for _ in range(draw.randint(0, most))]
        if draw.random() < 0.4:
            a, b = sorted(draw.sample(range(60), 2))
            at = draw.randint(0, len(own))
            own[at:at] = passage[a:b]
        out.append(draw.choice([" ", "\n", "  "]).join(own))
    out += [out[1], out[2], out[2].upper(), out[3] + " tail", "", "", None, None, " \n\t ", "x" * 3000, "y z " * 900]
    return out
