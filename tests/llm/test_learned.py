"""Toxicity, language identification and the block labeller: held-out quality and odd inputs."""

import random
import zlib

import numpy as np
import pytest

from solvara.llm import html_text, language_id, toxicity

FOLDER = "/root/testdata/sf0.01"


def held(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def test_toxicity_held_out(spark):
    r = random.Random(4)
    fine = [f"word{k}" for k in range(300)]
    rude = ["grobor", "grobina", "groblet", "zapfen", "idiot"]
    rows, labels = [], []
    for k in range(900):
        toxic = int(r.random() < 0.2)
        own = r.choices(fine, k=r.randint(5, 60))
        for _ in range(3 * toxic):
            own.insert(r.randrange(len(own)), r.choice(rude))
        rows.append((k, " ".join(own), "en"))
        labels.append((k, 1, toxic))
    rows += [(5000, None, None), (5001, "", None), (5002, "IDIOT! " * 40_000, None), (None, "no id", None), (3, "repeated id", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    lab = spark.createDataFrame([*labels, (5003, None, None), (None, 1, 1), (7, 0, labels[7][2])], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(docs, lab).collect()
    assert len(got) == len(rows)
    truth = {k: t for k, _, t in labels}
    judged = [(truth[g.doc_id], g.predicted) for g in got if g.held_out and g.doc_id in truth]
    assert all(g.held_out == held("" if g.doc_id is None else g.doc_id) for g in got)
    assert all(0 <= g.score <= 1 and g.predicted == int(g.score >= 0.3) for g in got)
    assert sum(a == b for a, b in judged) / len(judged) > 0.97 and len(judged) > 100
    kept = toxicity.without_toxic(docs, lab)
    assert kept.columns == docs.columns and kept.count() == sum(g.predicted == 0 for g in got)


def test_toxicity_on_the_given_tables(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{x}.parquet") for x in ("documents", "labels"))
    own = docs.join(labels, "doc_id").select("doc_id", "text", "lang", "toxic")
    truth = {r.doc_id: (r.lang, r.toxic) for r in own.select("doc_id", "lang", "toxic").collect()}
    got = [(*truth[r.doc_id], r.predicted) for r in toxicity.toxicity(own, labels).collect() if r.held_out]
    assert sum(p and y for _, y, p in got) > 0.9 * sum(y for _, y, _ in got)
    assert sum(p and y for _, y, p in got) > 0.95 * sum(p for *_, p in got)
    for lang in ("de", "en", "es", "fr"):  # languages with few labels are learned too
        assert sum(p and y for k, y, p in got if k == lang) >= 0.8 * sum(y for k, y, _ in got if k == lang)


def test_ties_and_repeated_rows_score_alike(spark):
    rows = [(k, f"plain words of row {k % 5}", "en" if k % 2 else "de") for k in range(40)] + [(7, "twice", "en")] * 3 + [(8, "twice", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(k, 1, int(k % 5 == 0)) for k in range(40)], "doc_id long, quality int, toxic int")
    scores = {}
    for r in toxicity.toxicity(df, labels).join(df.select("doc_id", "text").distinct(), "doc_id").collect():
        scores.setdefault(r.doc_id, set()).add(r.score)
    assert toxicity.toxicity(df, labels).count() == len(rows) and len(scores[7]) <= 2
    text = {k: t for k, t, _ in rows}
    pages = spark.createDataFrame([(1, "u", PAGE, 0)] * 3 + [(2, "u", PAGE, 0)], "page_id long, url string, html string, n_chars int")
    model = html_text.train(["some words to fill the layouts with"] * 3)
    found = html_text.main_text(pages, model).collect()
    assert len(found) == 4 and len({r.text for r in found}) == 1
    same = language_id.identify(df.where("doc_id IN (7, 8)")).collect()
    assert len(same) == 6 and text[8] == "twice"


def test_lexicon_learns_from_all_parts(spark):
    r = random.Random(9)
    part = lambda k: zlib.crc32(str(k).encode()) % 4
    toxic = {p: [k for k in range(900) if part(k) == p][:20] for p in range(4)}
    rows, labels = [], []
    for k in range(900):
        own = [f"word{r.randrange(300)}" for _ in range(20)]
        bad = k in toxic[part(k)]
        if bad:
            own.append("grobor")
        if k in toxic[part(k)][:2] and part(k) != 2:
            own.append("bomenteco")  # two toxic documents of each part: only all parts together reach the bar
        if bad and part(k) == 2:
            own.append("zapfen")
        rows.append((k, " ".join(own)))
        labels.append((k, 1, int(bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    lexicon = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).lexicon
    assert "grobor" in lexicon and "bomenteco" in lexicon and "zapfen" not in lexicon


@pytest.mark.parametrize("parts", [(3,), (0,), (0, 1)])
def test_toxicity_learns_where_one_part_holds_all_labels(spark, parts):
    """The score isn't a constant as long as the labels that may be learned from have both classes."""
    part = lambda k: zlib.crc32(str(k).encode()) % 4
    ids = [k for k in range(2000) if part(k) in parts][:200]
    texts = [(k, f"the weather number {k} is " + ("zorgish today" if n % 4 == 0 else "mild today")) for n, k in enumerate(ids)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(n % 4 == 0)) for n, k in enumerate(ids)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
    assert all(got[k].predicted == int(n % 4 == 0) for n, k in enumerate(ids))
    # labels of held-out rows teach nothing
    held = [k for k in range(2000) if part(k) == 2][:100]
    docs = spark.createDataFrame([(k, f"text {k} " + ("zorgish" if k % 2 else "mild")) for k in held], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in held], "doc_id long, toxic int")
    assert {r.score for r in toxicity.toxicity(docs, labels).collect()} == {0.0}


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [(r.score, r.predicted) for r in toxicity.toxicity(docs, none).collect()] == [(0.0, 0)] * 2
    one = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    assert [r.score for r in toxicity.toxicity(docs, one).collect()] == [0.0, 0.0]
    assert toxicity.toxicity(docs.limit(0), none).count() == 0


def test_feature_row_covers_whole_text():
    s = toxicity.Scorer({"scum": 3.0, "idio*": 2.0})
    tail = dict(zip(toxicity.FEATURES, s.row("word " * 50_000 + "you SCUM!!")))
    assert tail["lexicon_max"] == 3.0 and tail["second_near"] == 0.5 and tail["insult_any"] == 1.0
    veiled = dict(zip(toxicity.FEATURES, s.row("such an id10t and sc.u.m")))
    assert veiled["hidden_rate"] > 0 and veiled["hidden_lexicon"] == 2.0
    assert s.row(None) == s.row("") and not np.isnan(s.row("")).any()


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    lang = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    got = [r for r in language_id.identify(docs).collect() if r.held_out]
    assert len(got) > 100 and sum(lang[r.doc_id] == r.lang_pred for r in got) / len(got) > 0.98


def test_language_edges(spark):
    rows = [(k, "the quick brown fox jumps over it" if k % 2 else "el zorro salta sobre la casa roja", "en" if k % 2 else "es") for k in range(60)]
    odd = [(100, None, None), (101, "", None), (102, "123 !?", None), (103, "ЖЖЖЖ", None), (104, "the quick fox " * 200_000, None), (None, "el zorro rojo", None), (105, "THE QUICK BROWN", None)]
    df = spark.createDataFrame([(*r, "x") for r in rows + odd], "doc_id long, text string, lang string, lang_pred string")
    got = {r.doc_id: r for r in language_id.identify(df).collect()}
    assert [got[k].lang_pred for k in (100, 101, 102)] == ["und"] * 3 and got[102].score == 0.0
    assert got[103].score == 0.0 and got[104].lang_pred == got[105].lang_pred == "en" and got[None].lang_pred == "es"
    assert all(0 <= r.score <= 1 for r in got.values())
    assert {r.lang_pred for r in language_id.identify(df.where("lang IS NULL")).collect()} == {"und"}
    assert language_id.identify(df.limit(0)).count() == 0


def test_bloom_has_no_false_negatives_and_is_corrected():
    r = np.random.default_rng(1)
    sets = {x: r.integers(0, 2**63, 5000).astype(np.uint64) for x in ("a", "b")}
    bloom = language_id.LanguageBloom(["a", "b"], sets)
    assert all(((bloom.masks(sets[x])[:, 0] >> np.uint64(k)) & np.uint64(1)).all() for k, x in enumerate("ab"))
    other = (bloom.masks(r.integers(0, 2**63, 20_000).astype(np.uint64))[:, 0] & np.uint64(1)).mean()
    assert abs(other - bloom.false_rate[0]) < 0.03


def test_pieces_lose_nothing(monkeypatch):
    text = "eins zwei drei vier fünf sechs sieben " * 30
    whole = list(language_id.grams([text, "x", None]))
    monkeypatch.setattr(language_id, "PIECE", 50)
    cut = list(language_id.grams([text, "x", None]))
    count = lambda runs: sorted((int(h), int(o)) for hs, own, _ in runs for h, o in zip(hs, own))
    assert len(cut) > 1 and count(whole) == count(cut)
    assert sum(t for _, _, t in whole).tolist() == sum(t for _, _, t in cut).tolist()


PAGE = """<!doctype html><html><head><title>T</title><style>p{}</style><script>var a="<p>no</p>";</script></head><body>
<div class="cookie-notice"><p>We use cookies on this site to make it better for our readers.</p><button>OK</button></div>
<header><p>The Site</p></header><nav><ul><li><a href="/a">Home</a><li><a href="/b">World</a></ul></nav>
<article><h1>Title &amp; more</h1><p>First   paragraph of the <b>story</b><br>that is long enough to be one.<p>Second &#233;t&eacute; one here.</p><ul><li>an item of the list<li>two items</ul></article>
<aside class="sidebar"><h3>Related</h3><ul><li><a href="/z">Other story of the day</a></ul></aside>
<section id="comments"><h2>2 comments</h2><div class="comment"><p>I like this story very much, thanks for it.</p></div></section>
<form><label>Name</label><input><button>Send</button></form><footer>&copy; 2024 Site</footer></body></html>"""


def test_blocks():
    got = [(p[-1], t) for p, t, _ in html_text.blocks("<div>a <b>b</b>c<p>d<p>e&nbsp;f &amp g<!-- x --><br>h</div><script>no</script>")]
    assert got == [("div", "a bc"), ("p", "d"), ("p", "e f & g h")]
    assert [t for _, t, _ in html_text.blocks("<div>a</div>i<ul><li>j<li>k</ul><p")] == ["a", "i", "j", "k"]
    assert html_text.blocks("") == [] and html_text.blocks("<p></p><br>") == []
    # only scripts, styles and templates swallow what they hold; an element that isn't closed loses nothing
    text = lambda page: [t for _, t, _ in html_text.blocks(page)]
    assert text('<p>a <svg viewBox="0 0 1 1"/> b</p><p>c</p>') == ["a b", "c"] and text("<p>E = <math><mi>m</mi></math>c</p>") == ["E = mc"]
    assert text("<p>a</p><object><p>b</p><p>c") == ["a", "b", "c"] and text("<div>x<noscript>y</noscript>z</div>") == ["x", "y", "z"]
    assert text("<p>one <svg><title>icon</title></svg> line</p>") == ["one icon line"] and text("<p>a</p><template><p>b") == ["a"]


SEA = "<h1>A day at the sea</h1><p>We went to the sea early in the morning and stayed there until the evening came over the hills.</p><p>The water was cold, but nobody minded, and the children built a castle of sand.</p>"
BARE = f"<html><body><div><a href=/>Home</a><a href=/n>News</a></div><div>{SEA}</div><div><h3>2 comments</h3><div>Anna says:</div><div>I like this very much, thanks.</div><div>Ben says:</div><div>Me too, great read.</div></div><div>Copyright 2024</div></body></html>"
NAMED = f'<html><body><div class=menu><a href=/>Home</a></div><div id=content>{SEA}</div><div class=comments><p>I like this very much, thanks.</p></div><div class=footer>Copyright 2024</div></body></html>'
TABLE = f"<html><body><table><tr><td><a href=/>Home</a> <a href=/a>About</a></td></tr><tr><td>{SEA}</td><td><a href=/x>Other story</a><br><a href=/y>More news</a></td></tr><tr><td>Copyright 2024</td></tr></table></body></html>"


def test_labeller_on_unseen_layouts(spark):
    pages = spark.read.parquet(f"{FOLDER}/pages.parquet")
    model = html_text.fit(pages)
    features, wrong = html_text.Features(), 0
    r = np.random.default_rng(77)
    drawn = [html_text.layout(r, [f"alpha{k} beta{k} gamma{k} delta{k}" for k in range(50)]) for _ in range(150)]
    chance = model.predict([features.of(x) for x, _ in drawn])
    hit = np.concatenate([(p >= 0.5) == (y == 1) for p, (_, y) in zip(chance, drawn)])
    assert hit.mean() > 0.98
    for row in pages.select("html").collect():
        found = html_text.blocks(row.html)
        own = model.predict([features.of(found)])[0] >= 0.5
        wrong += any(o != any(e.split(".")[0] == "article" for e in p) for o, (p, _, _) in zip(own, found))
    assert wrong <= 0.02 * pages.count()
    story = [t for _, t, _ in html_text.blocks(SEA)]

    def kept(page):
        found = html_text.blocks(page)
        return [t for (_, t, _), p in zip(found, model.predict([features.of(found)])[0]) if p >= html_text.ARTICLE]

    assert kept(NAMED) == story
    # without telling names: the story stays, comments and footer go
    assert [t for t in kept(BARE) if t != "HomeNews"] == story
    assert kept(TABLE)[:2] == story[:2] and set(kept(TABLE)) <= set(story)
    df = spark.createDataFrame([(1, "u", PAGE, 0), (2, None, None, 0), (3, "v", "", 0), (None, "w", "<article>" + "<p>word after word, a sentence.</p>" * 5000 + "</article>", 0)], "page_id long, url string, html string, n_chars int")
    got = {r.page_id: r for r in html_text.main_text(df, model).collect()}
    assert got[1].text == "Title & more\nFirst paragraph of the story that is long enough to be one.\nSecond été one here.\nan item of the list\ntwo items"
    assert (got[2].text, got[3].text, got[2].n_chars, got[2].url) == ("", "", 0, None)
    assert got[None].text.count("\n") > 4900 and all(r.n_chars == len(r.text) for r in got.values())
    assert html_text.main_text(df.limit(0), model).count() == 0


def test_gradients_match_differences():
    model = html_text.Labeller(3)
    features, r = html_text.Features(), np.random.default_rng(2)
    drawn = [html_text.layout(r, ["one two three four five"]) for _ in range(3)]
    pages, labels = [features.of(x) for x, _ in drawn], [y for _, y in drawn]
    model.p = {k: v.astype(np.float64) + r.normal(0, 0.05, v.shape) for k, v in model.p.items()}
    got = model._gradients(pages, labels)

    def loss():
        x, lengths = model.inputs(pages)
        p = model.forward(x, lengths)[0]
        parts = [-(y * np.log(p[: len(y), k]) + (1 - y) * np.log(1 - p[: len(y), k])) for k, y in enumerate(labels)]
        return np.concatenate(parts).mean()

    for name in ("Wf", "Ub", "cf", "out", "path"):
        flat = np.abs(got[name]).ravel()
        at = np.unravel_index(int(flat.argmax()), got[name].shape)
        keep, step = model.p[name][at], 1e-2
        model.p[name][at] = keep + step
        up = loss()
        model.p[name][at] = keep - step
        down = loss()
        model.p[name][at] = keep
        assert abs((up - down) / (2 * step) - got[name][at]) < 0.05 * abs(got[name][at]) + 1e-4
