"""Inputs and fixtures shared by the tests of the subpackage."""
import pytest

ODD_URLS = [
    None, "", "no scheme/en/", "://", "http://", "HTTP://EXAMPLE.COM/en/", "http://www.Example.com/en/x", "http://example.com/en", "http://example.com/english/",
    "http://notexample.com/en/", "http://a.b.example.com/en/?q=1", "http://example.com?x=/en/", "http://x.net/es/", "http://x.net/fr/a#b", "http://net/es/", "http://x.net/de/",
    "http://com/", "http://com", "http://a.com:80/", "http://u@b.com/x", "https://adult-x.example.com/en/4", "https://my.adult.org/", "http://adults.org/", "http://h.org/a/login",
    "http://h.org/login.php?x", "http://h.org/pic.JPG", "http://h.org/pic.jpgx", "http://é.com/en/", "ftp://x//y://z", "http://example.com/\nen/", "http://casino.net/es/p",
]


@pytest.fixture(scope="session")
def rows(spark):
    def make(data, schema="doc_id long, text string"):
        return spark.createDataFrame(data, schema)

    return make


LONG = "".join(chr(97 + i * 7 % 26) + (" " if i % 6 == 5 else "") for i in range(60_000))
#: NULL, empty and very long texts, repeated rows and a NULL id.
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, LONG), (6, LONG), (6, LONG), (None, "no id here"), (7, "Ünïcödé ﬁ 😀 " * 3)]


@pytest.fixture(scope="session")
def odd(rows):
    """The odd rows with an extra column and one named like an output of many operators."""
    return rows([(i, t, "extra", "clash") for i, t in ODD], "doc_id long, text string, other string, kept string")
