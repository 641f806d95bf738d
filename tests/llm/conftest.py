import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """Nulls in any column, empty and long texts, ties, copies and repeated rows, odd characters."""
    base = " ".join(f"word{i % 97} item{i}" for i in range(60))
    near = base.replace("item33", "item-33")
    texts = {
        1: base, 2: base, 3: f"  {base}\t", 4: near, 5: None, 6: "", 7: " \n\t ", 8: "Öffnen Sie die Tür, bitte: ça va? 日本語テキスト 👍🏽 \u0085x\xa0y", 9: "one two",
        10: "ONE Two", 11: "x" * 70_000, 12: " ".join(f"t{i}" for i in range(30_000)), 13: "This is CC BY-NC and (c) All Rights Reserved. GNU General Public License; cc by cc by", 14: "0 1\x0b2\r\n3 ▁ ▁▁ a▁b  c ",
        15: "<|endoftext|> don't we'll x's", 16: "ﬁn é Å ﷺ ½ ﻿",
    }
    rows = [(i, t, "en" if i % 2 else "de", f"s{i % 3}", None if t is None else len(t)) for i, t in texts.items()]
    rows += [rows[0], (None, base, None, None, None), (None, None, None, None, None), (40, "Wörter " * 3, None, "s", 1)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def odd(documents):
    """The same with columns whose names clash with those the operators use."""
    from pyspark.sql import functions as F

    names = "key gram bucket row words norm rank salt split place length label score kept id center digest"
    return documents.select("*", *(F.lit("clash").alias(n) for n in names.split()))


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
