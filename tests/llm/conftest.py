import random

import pytest

from caselight.session import local_session


@pytest.fixture(scope="session")
def spark():
    s = local_session(4, "tests", **{"spark.driver.memory": "4g"})
    yield s
    s.stop()


@pytest.fixture(scope="session")
def texts():
    """Documents with copies, near copies, repeated lines, empty and long texts."""
    r = random.Random(5)
    words = ["".join(r.choice("abcdeimnorst") for _ in range(r.randint(2, 8))) for _ in range(400)] + ["É", "ßx", "日本", "naïve"]
    make = lambda n: " ".join(r.choice(words) for _ in range(n))
    base = [make(r.randint(20, 120)) for _ in range(25)]
    line = make(30)
    out = list(base)
    for b in base[:12]:
        w = b.split()
        for _ in range(3):
            v = list(w)
            for _ in range(r.randint(1, 3)):
                v[r.randrange(len(v))] = r.choice(words)
            out.append(" ".join(v))
    out += [base[0]] * 4 + [make(15) + "\n" + line + "\n" + make(15) for _ in range(6)]
    out += ["", " ", "one", "Two words", "a b c", "der " * 300, make(4000), "x" * 500, None]
    return out


@pytest.fixture(scope="session")
def documents(spark, texts):
    """The texts with an extra column whose name other tables use."""
    return spark.createDataFrame([(i, t, "a", f"src{i % 3}") for i, t in enumerate(texts)], "doc_id long, text string, id string, n string").repartition(5)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string")
