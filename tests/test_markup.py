"""Sections and notes of markup on small pages."""

from quillspark.operators import markup

PAGES = [
    (1, '<H1 class="x">A <b>b</b></h1>one<h3>C<a href="#n">*</a></h3>two <a href="#gone">?</a><h2>D</h2><h3>E</h3><script>var x = "<h2>no</h2>"</script><!-- <h2>no</h2> --><p id="n">the <i>note</i> &amp; more</p><p id="n">second</p>'),
    (2, None),
    (3, ""),
    (4, "<h2>never closed"),
    (5, "x" + "<h6>s</h6>" * 3000 + '<a href="#k">k</a><li id="k"></li>'),
]


def pages(spark, rows=PAGES):
    return spark.createDataFrame(rows, "id long, html string")


def test_sections(spark):
    rows = markup.sections(pages(spark).where("id < 5")).orderBy("id", "section").collect()
    assert [(r["section"], r["level"], r["parent"], r["title"]) for r in rows if r["id"] == 1] == [(0, 0, None, ""), (1, 1, 0, "A b"), (2, 3, 1, "C *"), (3, 2, 1, "D"), (4, 3, 3, "E")]
    assert [(r["id"], r["section"], r["level"], r["title"]) for r in rows if r["id"] > 1] == [(3, 0, 0, ""), (4, 0, 0, ""), (4, 1, 2, "")]
    assert [r["body"] for r in rows if r["id"] == 4 and r["section"] == 1] == ["<h2>never closed"]
    long = markup.sections(pages(spark).where("id = 5"))
    assert long.count() == 3001 and long.where("section > 0 AND parent <> 0").count() == 0


def test_notes(spark):
    rows = markup.notes(pages(spark)).orderBy("id", "section", "nth").collect()
    assert [(r["id"], r["section"], r["level"], r["nth"], r["anchor"], r["note"]) for r in rows] == [(1, 2, 3, 0, "n", "the note & more"), (1, 2, 3, 1, "gone", None), (5, 3000, 6, 0, "k", "")]
    assert markup.notes(pages(spark, [])).count() == 0 and markup.sections(pages(spark, [])).count() == 0
