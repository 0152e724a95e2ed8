from skeinkg.llm import markup as M


def kinds(text, stored=None):
    f = M.recognised(text, stored)
    return f, [(k, t) for k, t in M.blocks(text, f) if k != "text"]


def test_formats_are_read_from_the_text():
    md = "---\nbox: 1\n---\n\nTitle *x*\n=====\n\n* a **b**\n  1. c `d`\n\n    # code\n    - x\n\nText $x_1$ costs $5 to $7.\n\n$$\ny\n$$\n\n```py\nz = 1\n```\n\n## Two ##\n"
    assert kinds(md, "txt") == ("md", [("heading", "Title x"), ("list_item", "a b"), ("list_item", "c d"), ("code", "    # code\n    - x"), ("formula", "x_1"), ("formula", "y"), ("code", "z = 1"), ("heading", "Two")])
    html = "<!-- n --><h1>A&nbsp;<b>b</b></h1><ul><li>one<li>two &amp; 3</ul><pre><code>if a &lt; b:\n  - 1</code></pre><p>(<span class='math'>x \\to y</span>) \\[z\\]</p><table><tr><td>1</td><td></td></tr></table>"
    assert kinds(html) == ("html", [("heading", "A b"), ("list_item", "one"), ("list_item", "two & 3"), ("code", "if a < b:\n  - 1"), ("formula", "x \\to y"), ("formula", "z"), ("row", "1\t")])
    wiki = "{{Box\n| a = 1\n}}\n== H ''i'' ==\n# one [[X|two]]\n#three\n:<math>a^2</math>\nText.<ref>n</ref>\n<syntaxhighlight lang='x'>\n* c\n</syntaxhighlight>\n[[Category:Y]]"
    assert kinds(wiki) == ("wiki", [("heading", "H i"), ("list_item", "one two"), ("list_item", "three"), ("formula", "a^2"), ("code", "* c")])
    tex = "% draft\n\\section*{Ir\\`ene \\textbf{x}}\\label{s}\n\nText\\footnote{n} 5\\% (\\(a\\)).\n\\begin{equation}\nb\n\\end{equation}\n\\begin{itemize}\n  \\item one {\\it two}\n  \\item three\n\\end{itemize}\n\\begin{verbatim}\n- 1\n\\end{verbatim}"
    assert kinds(tex) == ("tex", [("heading", "Irène x"), ("formula", "a"), ("formula", "b"), ("list_item", "one two"), ("list_item", "three"), ("code", "- 1")])


def test_traps_are_plain():
    for t in ("The price rose from $5 to $7 today.", "In C# notation the key is {draft}.", "The file tape_old_2 was kept.", "5 * 3 = 15", "If a < b and c > d then.", "R&D paid.", "– said he.\n– said she.", "- typed\n- bullets", "[sic]", "", None, "   "):
        assert M.recognised(t or "", "md") is None
    assert M.blocks(None, None) == [] and M.blocks("<div><p>open", "html") == [("text", "open")]


def test_votes_and_elements(spark):
    page = "<div class='nav7'><a>x</a><a>y</a></div><div id='main'><h1>T</h1><p>long text here and more of it</p></div>"
    docs = spark.createDataFrame([(i, "h" if i < 5 else None, "html", page) for i in range(6)] + [(9, "h", None, None), (10, "h", None, "")], "doc_id bigint, source string, format string, text string")
    assert {(r["path"], tuple(r["bad"])) for r in M.winning_paths(docs).collect()} == {("div#main", ("div.nav",))}
    got = M.marked_elements(M.document_blocks(docs))
    assert sorted({(r["element"], r["element_text"]) for r in got.collect()}) == [("document", ""), ("heading", "T")]
    assert got.select("id").distinct().count() == 6
    clean = M.document_blocks(docs).where("id = '0'").select(M.clean_text().alias("t")).first()["t"]
    assert clean == "# T\nlong text here and more of it"  # the links are gone
    assert M.document_blocks(docs.limit(0)).count() == 0
    few, M.WINNERS = M.WINNERS, -1
    try:
        assert sorted(tuple(r) for r in M.marked_elements(M.document_blocks(docs)).collect()) == sorted(tuple(r) for r in got.collect())
    finally:
        M.WINNERS = few


def test_paths_decide_what_is_read(spark):
    menu = "<nav><ul><li><a href='/'>Home</a></li><li><a href='/x'>List of letters</a></li></ul></nav>"
    main = "<div id='main'><h1>T{}</h1><p>Long text that says something here.</p><ul><li>true item {}</li></ul></div>"
    side = "<aside><h2>Related</h2><ul><li><a>One</a></li><li><a>Two</a></li></ul></aside>"
    foot = "<footer>Made by hand in Crelfield</footer>"
    note = "<div class='note'><p>A remark of length beside it, no link in sight.</p></div>"
    pages = ["<body>" + menu + main.format(i, i) + side + note + foot + "</body>" for i in range(4)]
    other = "<body><ul><li><a>only</a></li></ul><p>Text outside of all.</p></body>"
    docs = spark.createDataFrame([(i, "h", "html", t) for i, t in enumerate([*pages, other])], "doc_id bigint, source string, format string, text string")
    (row,) = M.winning_paths(docs).collect()
    assert row["path"] == "body" and set(row["bad"]) == {"body/nav", "body/aside", "body/footer"}
    found = {int(r["id"]): [(b["kind"], b["text"]) for b in r["blocks"]] for r in M.document_blocks(docs).collect()}
    for i in range(4):
        assert found[i] == [("heading", f"T{i}"), ("text", "Long text that says something here."), ("list_item", f"true item {i}"), ("text", "A remark of length beside it, no link in sight.")]
        assert M.blocks(pages[i], "html") != found[i]  # without the votes the menu stays
    assert found[4] == [("list_item", "only"), ("text", "Text outside of all.")]
