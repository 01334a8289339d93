from cohortlens.llm import language_fusion as lf

SCHEMA = "page_id bigint, url string, html string, host string, said string"


def test_pages_against_their_text(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = lf.identify(pages, docs).collect()
    assert len(out) == pages.count() and all(0 < r["confidence"] <= 1 for r in out)
    declared = {r["page_id"]: lf.parts_of(r["html"], r["url"])[0] for r in pages.collect()}
    assert sum(r["lang"] == declared[r["page_id"]] for r in out) > 0.97 * len(out)
    assert sum(r["text_lang"] == declared[r["page_id"]] for r in out) > 0.9 * len(out)


def test_parts():
    page = "<HTML class=x LANG='de-AT'><p>x</html>"
    assert lf.parts_of(page, "https://u@Blog.Shop.example.de:80/fr/1?x") == ("de", "fr", "blog.shop.example.de", "example.de", "de")
    assert lf.parts_of("<html>", "http://h.es/frank") == ("", "", "h.es", "h.es", "es")
    assert lf.parts_of("", "no address") == ("", "", "", "", "")
    assert lf.visible("<p>a&amp;b<script>var x='<p>'</script><!-- c --> d").split() == ["a&b", "d"]


def test_evidence_is_fused(spark):
    docs = [("the quick words of this and that are in there " * 3, "en")] * 30 + [("die schnellen wörter von diesem und jenem sind dort " * 3, "de")] * 30
    docs = spark.createDataFrame(docs, "text string, lang string")
    german, english = "die wörter sind schnell und dort", "the words are quick and there"
    rows = [(i, f"http://www.haus.de/{i}", f'<html lang="de"><p>{german}') for i in range(20)]
    rows += [(100 + i, f"http://www.home.uk/{i}", f'<html lang="en"><p>{english}') for i in range(20)]
    rows += [(200, "http://www.haus.de/x", "<p></p>"), (201, "http://www.home.uk/x", None), (202, None, None), (202, None, None), (203, "http://neu.haus.de/", "")]
    pages = spark.createDataFrame([(*r, "h", "s") for r in rows], SCHEMA).repartition(3)
    out = {r["page_id"]: r for r in lf.identify(pages, docs).collect()}
    assert all(out[i]["lang"] == "de" and out[100 + i]["lang"] == "en" for i in range(20))
    assert (out[200]["lang"], out[201]["lang"], out[203]["lang"]) == ("de", "en", "de") and out[202]["n_grams"] == 0
    assert lf.identify(pages, docs).count() == len(rows)
    assert {r["lang"] for r in lf.identify(pages, docs.limit(0)).collect()} == {None}
    assert lf.identify(pages.limit(0), docs).count() == 0


def test_rare_languages_are_known(spark):
    """One frequent language and a tail of 60, each 0.1 % of the documents: all have a model and can be the answer."""
    names = [f"{a}{b}" for a in "qrstvx" for b in "abcdefghij"]
    words = {name: " ".join(f"{name}{x}{name[::-1]}{y}" for x in "aeiou" for y in "lmnr") for name in names}
    tail = spark.createDataFrame([(words[name] * 3, name) for name in names for _ in range(4)], "text string, lang string")
    docs = tail.unionByName(spark.range(4000).selectExpr("repeat('the quick words of this and that are in there ', 3) AS text", "'en' AS lang"))
    docs = docs.unionByName(spark.createDataFrame([("too little", "zz")], "text string, lang string"))
    rows = [(i, f"http://h{i}.org/{name}/x", f'<html lang="{name}"><p>{words[name]}') for i, name in enumerate(names)]
    rows += [(100 + i, f"http://k{i}.org/", f"<p>{words[name]}") for i, name in enumerate(names)]
    rows += [(200, "http://k.org/", "<html lang=zz><p>the words are quick and there")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    out = {r["page_id"]: r for r in lf.identify(pages, docs).collect()}
    assert len(lf.text_model(docs)[0]) == 61 and len(out) == len(rows)
    for i, name in enumerate(names):
        assert (out[i]["lang"], out[i]["declared"], out[i]["path"]) == (name, name, name) and out[100 + i]["lang"] == name
    assert (out[200]["lang"], out[200]["declared"]) == ("en", "other")
