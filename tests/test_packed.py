from pyspark.sql import functions as F

from bibflux.operators.packed import explode_packed, packed_values
from tests.conftest import rows


def split(spark, texts, names):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(packed_values(F.col("t"), names)).collect()]


def test_persons(spark):
    cases = {
        "Raduladen, R., Mavatogis, O.": ["Raduladen, R.", "Mavatogis, O."],
        "H. Linobugerd, Chiara Tusitadurd": ["H. Linobugerd", "Chiara Tusitadurd"],
        "de Bucigejos, Dario\r\nSergio R. Gofo": ["de Bucigejos, Dario", "Sergio R. Gofo"],
        "A. One, B. Two, and van Three S": ["A. One", "B. Two", "van Three S"],
        "Hib, G. and Haf, Ursula y Bis, Carla": ["Hib, G.", "Haf, Ursula", "Bis, Carla"],
        '"Sp, J."; Robert Can; "Mod, Yara"': ["Sp, J.", "Robert Can", "Mod, Yara"],
        "Naveen Huf; ; Din, T.;Tov, Yus.; ": ["Naveen Huf", "Din, T.", "Tov, Yus."],
        "Leb, O. |": ["Leb, O."],
        "ADELA MOZO": ["ADELA MOZO"],
    }
    assert split(spark, list(cases), True) == list(cases.values())


def test_keywords(spark):
    cases = {
        '"libraries, academic","formative literacy"': ["libraries, academic", "formative literacy"],
        'a, "so-called ""prompt craft""", b': ["a", 'so-called "prompt craft"', "b"],
        '["a b", "the ""gap"""]': ["a b", 'the "gap"'],
        'So-called "prompt craft";LOW': ['So-called "prompt craft"', "LOW"],
        "bias, algorithmic; pre/post testing;;Q&A": ["bias, algorithmic", "pre/post testing", "Q&A"],
        "one / two": ["one", "two"],
        "one · two": ["one", "two"],
        "reading and writing, b": ["reading and writing", "b"],
        'lone " quote; b': ['lone " quote', "b"],
    }
    assert split(spark, list(cases), False) == list(cases.values())


def test_blank_and_long(spark):
    assert split(spark, [None, "", "  ", "NaN", " none ", ";;", '""'], False) == [[]] * 7
    assert len(split(spark, ["; ".join(f"k{i}" for i in range(20000))], False)[0]) == 20000


def test_explode_positions_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "x; y", None, 9, "z"), (1, "x; y", None, 9, "z")], "record_id long, keywords string, authors string, pos int, value string")
    got = rows(explode_packed(df, "record_id", {"authors": True, "keywords": False}))
    assert got == [(1, "keywords", 1, "x"), (1, "keywords", 1, "x"), (1, "keywords", 2, "y"), (1, "keywords", 2, "y")]
    assert explode_packed(df.limit(0), "record_id", {"keywords": False}).count() == 0


def test_very_long_fields(spark):
    """No pattern goes as deep as a field is long."""
    long = ["de " * 20000 + "x", '"' + 'a""b' * 20000 + '"', '"' * 5001 + ";" * 3000, "x, " * 20000, "a" * 100000]
    df = spark.createDataFrame([(k, v, v) for k, v in enumerate(long)], "record_id int, authors string, keywords string")
    got = {(r.record_id, r.field): r.n for r in explode_packed(df, "record_id", {"authors": True, "keywords": False}).groupBy("record_id", "field").count().withColumnRenamed("count", "n").collect()}
    assert got[1, "keywords"] == got[4, "keywords"] == got[4, "authors"] == 1 and got[3, "keywords"] == 20000
