"""Language ID: backing off, and accuracy on held-out documents."""

import zlib

from conftest import SF01
from fixtures_llm import no_docs, odd_docs

from pulse.llm import langid
from pulse.llm.common import read


def test_known_words_come_first_and_unseen_ones_back_off():
    m = langid.Model(["de", "en"], {"the": [1, 90], "und": [80, 1]}, {"sch": [50, 2], "th": [1, 60], "x": [1, 3]})
    assert m.score("The und the")[0] == "en" and m.score("und")[0] == "de"
    assert m.back_off("fisch") == m.grams["sch"]  # no longer n-gram is known
    assert m.back_off("bath") == m.grams["th"] and m.back_off("ax") == m.grams["x"]
    assert m.back_off("q") == (0.0, 0.0)
    assert m.score("q") == ("de", 0.5)  # a tie: the first language
    assert m.score("12 §$") == ("und", 0.0) and m.score("") == ("und", 0.0)
    back = langid.Model.of(m.state())
    assert back.score("the fisch th") == m.score("the fisch th")


def test_held_out_accuracy(spark):
    docs = read(spark, SF01, "documents")
    got = langid.report(docs).collect()
    lang = {r["doc_id"]: (r["lang"], r["text"]) for r in docs.collect()}
    assert len(got) == len(lang)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert all(0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["held_out"] and len(lang[r["doc_id"]][1].split()) >= 5]
    assert sum(r["lang_pred"] == lang[r["doc_id"]][0] for r in held) >= 0.98 * len(held)


def test_odd_rows(spark):
    docs = odd_docs(spark)
    got = langid.report(docs).collect()
    assert len(got) == docs.count()
    by = {r["doc_id"]: r for r in got}
    assert all(by[i]["lang_pred"] == "und" for i in (2000, 2001, 2002)) and by[2008]["lang_pred"] == "und"
    kept = langid.known_language(docs)
    assert kept.schema == docs.schema and kept.count() == sum(r["lang_pred"] != "und" for r in got)
    assert langid.report(no_docs(spark)).count() == 0
    unlabelled = docs.drop("lang").selectExpr("*", "cast(null as string) as lang")
    assert {r["lang_pred"] for r in langid.report(unlabelled).collect()} == {"und"}


def test_numerals_are_no_letters(spark):
    assert langid.words_of("½ ² ① Ⅷ x² a½b Éa_b9c") == ["x", "a", "b", "éa", "b", "c"]
    m = langid.Model(["de", "en"], {"x": [1, 9], "y": [9, 1]}, {"x": [1, 3]})  # one word alone would be all of either language
    assert m.score("½ ² ① Ⅷ") == ("und", 0.0) and m.score("x²")[0] == "en"
