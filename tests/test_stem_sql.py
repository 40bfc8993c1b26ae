"""The stemmer's SQL against the stemmer."""

import duckdb
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerlens.functions.porter import stem
from ledgerlens.plans.stem_sql import IRREGULAR, STEP2, STEP3, STEP4, stem_ctes

ENDINGS = ["", "s", "sses", "ies", "ied", "eed", "ed", "ing", "y", "e", "ll", "sky", "yyy",
           *[e.split()[0] for t in (STEP2, STEP3) for e in t.split(", ")], *STEP4.split()]
WORDS = st.tuples(st.text("abeilorstyzwx19", max_size=6), st.sampled_from(ENDINGS),
                  st.sampled_from(["", "s", "ed", "ing", "ly", "ment"])).map("".join)


@given(st.lists(WORDS.filter(bool), min_size=300, max_size=300))
@settings(max_examples=8, deadline=None)
def test_sql_stems_like_the_stemmer(words):
    words = sorted({*words, *(e.split()[0] for e in IRREGULAR.split(", "))})
    con = duckdb.connect()
    con.execute("CREATE TABLE words(t VARCHAR)")
    con.executemany("INSERT INTO words VALUES (?)", [[w] for w in words])
    got = dict(con.execute(f"WITH {stem_ctes('words')} SELECT t, stem FROM stems").fetchall())
    assert got == {w: stem(w) if len(w) > 3 else w for w in words}
