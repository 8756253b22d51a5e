"""Scholarly pages to rows, on pages of known make."""

from marlstone.sources import scholarly as S

PAGE = "page_id long, html string, url string"


def found(spark, text, url=None):
    return S.papers(spark.createDataFrame([(1, text, url)], PAGE), url="url")


def kinds(spark, text):
    return [(r.kind, r.parent, r.label, r.text) for r in S.part(found(spark, text), "blocks", number="block").orderBy("block").collect()]


def test_blocks_and_their_parents(spark):
    got = kinds(
        spark,
        "<article><h1>T</h1><div class='ltx_abstract'><h6>Abstract</h6><p>sum</p></div><h2>A</h2><p>let <math alttext='x^2' display='block'><mi>x</mi></math> be</p><h3>B</h3><div class='ltx_theorem'><h6>Theorem 1</h6><p>so</p></div><div class='ltx_proof'>qed</div>"
        "<script>no</script><h2>C</h2><ul><li>one<figure><img src='i.png'></figure></li><li>two</li></ul><figure class='ltx_algorithm'><figcaption>Algorithm 1</figcaption>do</figure><section class='ltx_appendix'><h2>D</h2><p>end</p></section><table class='ltx_equation'><tr><td><math alttext='y'></math></td></tr></table><table><tr><td>layout</td></tr></table></article>",
    )
    assert got == [
        ("title", None, None, "T"), ("abstract", None, None, "sum"), ("heading", None, None, "A"), ("paragraph", 2, None, "let x^2 be"), ("formula", 3, "display", "x^2"), ("heading", 2, None, "B"), ("theorem", 5, None, "Theorem 1so"), ("proof", 5, None, "qed"),
        ("heading", None, None, "C"), ("list", 8, None, "onetwo"), ("list_item", 9, None, "one"), ("list_item", 9, None, "two"), ("figure", 8, "Image 1", ""), ("algorithm", 8, None, "Algorithm 1do"), ("heading", None, None, "D"), ("paragraph", 14, None, "end"), ("formula", 14, None, "y"),
    ]


def test_figures_within_figures(spark):
    text = "<article><figure><figure><img src='a'><figcaption>Fig. 3</figcaption></figure><figure><object></object><figcaption>Figure 4</figcaption></figure></figure><figure class='ltx_table'><figure class='ltx_figure_panel'><figcaption>Table A1</figcaption><table><tr><td>1</table></figure><figure class='ltx_figure_panel'><figcaption>Table 2</figcaption><table></table></figure></figure><figure><figcaption>Listing 1: x</figcaption>code</figure></article>"
    got = found(spark, text)
    assert [(b.kind, b.label) for b in got.first().blocks if b.kind != "caption"] == [("figure", "Figure 3"), ("figure", "Figure 4"), ("table", "Table A1"), ("table", "Table 2"), ("code", None)]
    assert [(p.label, p.src, p.state) for p in got.first().panels] == [("a", "a", "local"), ("a", None, "missing")]
    assert got.first().reasons == ["html_title_missing", "html_figure_media_incomplete", "html_table_empty"]


def test_authors(spark):
    marked = "<h1>T</h1><div class='ltx_authors'><span class='ltx_creator'><span class='ltx_personname'>A</span><span class='ltx_affiliation'>U</span><span class='ltx_affiliation'>U</span> a@u.org A@U.ORG</span><span class='ltx_creator'><span class='ltx_personname'>A</span></span><span class='ltx_personname'></span></div><p>x</p>"
    got = [(a.name, a.affiliations, a.emails) for a in found(spark, marked).first().authors]
    assert got == [("A", ["U"], ["a@u.org", "A@U.ORG"]), ("A", [], [])]
    listed = "<meta name='citation_author' content='B'><meta name='citation_author' content='C'><meta name='citation_author_institution' content='V'><p>x</p>"
    assert [(a.name, a.affiliations) for a in found(spark, listed).first().authors] == [("B", ["V"]), ("C", [])]


def test_links_find_their_anchors(spark):
    text = (
        "<article><section id='S1'><h2>One</h2><p id='p1'>see <a class='ltx_ref' href='#b1'>1</a> <a href='#S1'>s</a> <a href='#none'>n</a> <a href='../x.html'>x</a> <a href='javascript:y'>j</a> <a href='http://[bad'>z</a></p></section>"
        "<ul class='ltx_biblist'><li class='ltx_bibitem' id='b1'><span id='in'>A. 2001.</span> doi:10.1000/a.b(c).</li><li class='ltx_bibitem' id='b2'>Z, 12001 pages</li><li class='ltx_bibitem' id='b1'>again</li></ul></article>"
    )
    f = found(spark, text, "https://x.org/a/b.html")
    got = [(r.kind, r.target, r.status, r.to_block, r.to_entry, r.block) for r in S.references(f).orderBy("place").collect()]
    assert got == [("citation", "#b1", "resolved", 3, True, 1), ("internal", "#S1", "resolved", 0, False, 1), ("internal", "#none", "unresolved", None, None, 1), ("external", "https://x.org/x.html", "outside", None, None, 1)]
    assert [(r.entry, r.block, r.doi, r.year, r.cited) for r in S.bibliography(f).orderBy("entry").collect()] == [("b1", 3, "10.1000/a.b(c", 2001, 1), ("b2", 4, None, None, 0)]
    assert f.first().reasons == ["html_title_missing", "html_unsafe_reference_ignored"]


def test_preprints(spark):
    assert found(spark, "<p>x</p>", "https://arxiv.org/abs/2301.00001v2").first().preprint == "2301.00001"
    assert found(spark, "<meta name='citation_arxiv_id' content='arXiv:1234.56789'><p>x</p>", "https://x.org/2301.00001").first().preprint == "1234.56789"


def test_nulls_deep_and_broken_pages(spark):
    rows = spark.createDataFrame([(1, None, None), (2, "<div>" * 20000 + "x<p>y", None), (3, "<<<a b='", None), (None, "<article>" + "<p>x</p>" * 20000, None), (5, "", None)], PAGE)
    got = {r.page_id: (r.status, len(r.blocks)) for r in S.papers(rows).collect()}
    assert got == {1: ("rejected", 0), 2: ("degraded", 1), 3: ("rejected", 0), None: ("degraded", 20000), 5: ("rejected", 0)}
    assert S.references(S.papers(rows.limit(0))).count() == 0


def test_only_the_fields_asked_for(spark):
    text = "<article><h1>T</h1><p>x <a href='#b'>c</a> <a href='javascript:y'>j</a></p><p>Permission to <b>reproduce</b> this figure</p><div class='ltx_creator'><span class='ltx_personname'>A</span></div><li class='ltx_bibitem' id='b'>B 2001</li></article>"
    rows = spark.createDataFrame([(1, text, None)], PAGE)
    whole = S.papers(rows).first().asDict(recursive=True)
    assert [b["text"] for b in whole["blocks"]] == ["T", "x c j"] and whole["reasons"] == ["html_unsafe_reference_ignored"]
    for fields in (("authors",), ("status",), ("blocks", "anchors"), ("links",), ("title", "reasons")):
        got = S.papers(rows, fields=fields).first().asDict(recursive=True)
        assert got == {k: whole[k] for k in ("page_id", *fields)}


def test_entries_of_pages_without_a_key_keep_their_texts(spark):
    rows = spark.createDataFrame([(None, "<article><ul><li class='ltx_bibitem' id='b'>B 2001 doi:10.1000/x</li></ul></article>", None)], PAGE)
    assert [(r.entry, r.doi, r.year) for r in S.bibliography(S.papers(rows)).collect()] == [("b", "10.1000/x", 2001)]


def test_what_links_lead_to_is_found_within_the_page(spark):
    """Exploded anchors and blocks went to all tasks, as their table is small: by the driver, which can't hold them."""
    page = '<article><h1 id="t">T</h1><p id="p">a <a href="#t">x</a><a href="#none">y</a><a href="https://x.org/#t">z</a><a href="#">top</a></p><ul><li id="b" class="ltx_bibitem">B <a href="#b">b</a></li></ul></article>'
    rows = spark.createDataFrame([*((k, page) for k in range(100)), (None, page), (200, "<p>no link</p>"), (201, None)], "page_id long, html string")
    got = S.references(S.papers(rows, fields=("blocks", "links", "anchors")))
    assert got.columns == ["page_id", "place", "block", "kind", "target", "label", "to_block", "to_entry", "status"]
    found = {}
    for r in got.collect():
        found.setdefault(r.page_id, []).append((r.place, r.target, r.status, r.to_block, r.to_entry))
    want = [(0, "#t", "resolved", 0, False), (1, "#none", "unresolved", None, None), (2, "https://x.org/#t", "outside", None, None), (3, "#", "unresolved", None, None), (4, "#b", "resolved", 3, True)]
    assert set(found) == {*range(100), None} and all(sorted(x) == want for x in found.values())
    query = S.scholarly_references(spark, "/root/testdata/sf0.001")
    assert "Join" not in query._jdf.queryExecution().optimizedPlan().toString() and query.count() > 0
