import itertools
import math
import os

import numpy as np
import pytest

from websift.llm import crf, langid, pagepass, residue, spam, trees

SAMPLES = [
    ("en", "The old harbour opens its doors again. The village library needs more volunteers early in the morning."), ("en", "Every gardener measures rainfall in the valley, and the small museum has found a forgotten map."),
    ("de", "Der alte Hafen öffnet wieder seine Türen. Die Dorfbibliothek braucht mehr Freiwillige früh am Morgen."), ("de", "Jeder Gärtner misst den Regen im Tal, und das kleine Museum hat eine vergessene Karte gefunden."),
    ("fr", "Le vieux port rouvre enfin ses portes. La bibliothèque du village cherche de nouveaux bénévoles tôt le matin."), ("fr", "Chaque jardinier mesure la pluie dans la vallée, et le petit musée a retrouvé une carte oubliée."),
]


@pytest.fixture(scope="module")
def model():
    return langid.train([*SAMPLES, ("en", None), (None, "x"), ("en", " ")], langid.vocabulary())


def test_languages(model):
    for text, want in (("the village needs a map in the morning", "en"), ("die Karte und der Regen am Morgen", "de"), ("la carte et la pluie du matin", "fr")):
        assert langid.identify(model, text)[0] == want and 0.5 < langid.identify(model, text)[1] <= 1
    assert langid.identify(model, None) == langid.identify(model, "") == langid.identify(model, "12 !") == (None, 0.0)
    assert langid.identify(model, "東の港で市が開かれる")[0] == "ja"
    assert langid.identify(model, "the " * 20_000)[0] == "en"


def test_forward_sums_all_segmentations():
    pieces = {"▁a": 0, "b": 1, "▁ab": 2, "▁": 3, "a": 4, "ab": 5}
    probs = np.array([[0.1], [0.2], [0.05], [0.3], [0.15], [0.07], [1e-6]])
    edges = langid._edges(["▁ab"], pieces, 3)
    alpha = langid._forward(1, edges, probs)[0, 3, 0]
    want = 0.05 + 0.1 * 0.2 + 0.3 * 0.07 + 0.3 * 0.15 * 0.2
    assert math.isclose(alpha, want)


def test_labels():
    same = {"en": "en", " EN ": "en", "en_US": "en", "Fr-be": "fr", "français": "fr", "English": "en", "deu": "de", "es-419": "es", "nld": "nl", "pt-BR": "pt", "it, it-IT": "it"}
    assert {k: langid.declared(k) for k in same} == same
    assert [langid.declared(x) for x in (None, "", "-", "und", "mul", "zxx", "xx", "utf-8", "{{ lang }}", "default", "en, fr")] == [None] * 11


def test_viterbi_and_training():
    rng = np.random.default_rng(0)
    lengths = np.array([4, 1, 0, 3])
    emit, trans = rng.normal(size=(8, 2)), rng.normal(size=(2, 2))
    got = crf.viterbi(emit, trans, crf.Chains(lengths))
    at = 0
    for n in lengths:
        best = max(itertools.product((0, 1), repeat=int(n)), key=lambda y: sum(emit[at + i, v] for i, v in enumerate(y)) + sum(trans[a, b] for a, b in itertools.pairwise(y))) if n else ()
        assert tuple(got[at : at + n]) == best
        at += n
    labels = np.tile([0, 0, 1, 1, 1, 0], 50)
    codes = np.stack([labels * 2 + rng.integers(0, 2, 300), 4 + rng.integers(0, 3, 300)], axis=1)
    w, t = crf.train(codes, labels, np.full(50, 6), 7, 60)
    e = np.zeros((300, 2))
    e[:, 1] = w[codes].sum(axis=1)
    assert (crf.viterbi(e, t, crf.Chains(np.full(50, 6))) == labels).mean() == 1


def test_residue():
    for t in ("Hi {{ name }}", "<%= x %>", "[[date]]", "a NaN b", "(unset)", "[object Object]", "%%CITY%%", "&lt;user&gt;", "{first_name}", "x null y", "$date$", "*|USER|*", "__BODY__", "@Model.x"):
        assert residue.has_leftover(t), t
    for t in (None, "", "a {b c} d", "Nullpunkt", "price $5 and $6", "2 < 3 > 1", "undefined variable $x", "snake_case", "nulla"):
        assert not residue.has_leftover(t), t
    j = residue.Judge()
    assert j.replaces_content(["404 - the page you asked for was not found", "Ref 0b6e97f0 / 460"], [])
    assert j.replaces_content([], ["Bitte aktivieren Sie JavaScript, um diese Seite zu sehen."])
    assert j.replaces_content(["Lorem ipsum dolor sit amet consectetur adipiscing elit sed"], [])
    article = ["Why sites ask you to enable JavaScript"] + ["The old harbour opens its doors again in the morning, and nobody knows why this happened."] * 8
    assert not j.replaces_content(article, ["Please enable JavaScript to view this page"])
    assert not j.replaces_content([], [])


def test_trees():
    rng = np.random.default_rng(1)
    x = rng.random((300, 4))
    y = ((x[:, 0] > 0.5) & (x[:, 2] < 0.4)).astype(int)
    assert ((trees.predict(trees.fit(x, y, 20), x) > 0.5) == y).mean() > 0.97
    assert trees.fit(x[:0], y[:0]) == [] and (trees.predict([], x) == 0).all()


def test_weak_labels():
    common = spam.function_words([*SAMPLES, ("en", None), (None, "x")])
    label = lambda t, a="": spam.weak_label(t, a, common)
    story = " ".join(t for la, t in SAMPLES if la == "en")
    assert label(story) == 0 and label("") == label(None) == 0
    assert label("cheap sofa lamp deal cheap sofa lamp deal") == 1
    assert label(story, "sofa lamp deal cheap " * 6) == 1
    assert label("\n".join(f"The old harbour opens its doors for {w} in the morning." for w in ("lamps", "sofas", "chairs", "tables") * 3)) == 1


def test_features_of_empty_pages():
    import pyarrow as pa

    none = pa.array([], pa.string())
    i = np.zeros(0, np.int64)
    x = spam.features(none, i, i.astype(bool), i.astype(bool), none, i, 2, pa.array(["a"]))
    assert x.shape == (2, len(spam.FEATURES)) and not spam.has_words(x).any()


@pytest.fixture(scope="module")
def full_model():
    pq = pytest.importorskip("pyarrow.parquet")
    path = "/root/testdata/sf0.001/lang_samples.parquet"
    if not os.path.exists(path):
        pytest.skip("no test data")
    t = pq.read_table(path)
    return langid.calibrate(list(zip(t["lang"].to_pylist(), t["text"].to_pylist(), strict=True)), langid.vocabulary())


def test_languages_the_model_does_not_know(full_model):
    other = {
        "sv": "Grannen köpte tre cyklar i går eftersom hans dotter ville resa genom Skottland under sommaren med sina vänner.",
        "pl": "Sąsiad kupił wczoraj trzy rowery, ponieważ jego córka chciała latem podróżować po Szkocji z przyjaciółmi.",
        "fi": "Naapuri osti eilen kolme polkupyörää, koska hänen tyttärensä halusi matkustaa kesällä Skotlannissa ystäviensä kanssa.",
    }
    assert {k: langid.identify(full_model, t) for k, t in other.items()} == dict.fromkeys(other, ("und", 0.0))
    known = {"en": "The neighbour bought three bicycles because her daughter wanted to travel in the summer with friends.", "it": "Il vicino ha comprato tre biciclette perché la figlia voleva viaggiare con gli amici.", "fr": "Le voisin a acheté trois bicyclettes parce que sa fille voulait voyager avec des amis."}
    assert {k: langid.identify(full_model, t)[0] for k, t in known.items()} == {k: k for k in known}


def test_scripts():
    uk, ru = "Сусід купив три велосипеди, бо його донька хотіла подорожувати влітку.", "Сосед вчера купил три велосипеда, потому что дочь хотела ездить летом по горным тропам, и мы это видели."
    assert langid.script_language(uk)[0] == "uk" and langid.script_language(ru)[0] == "ru"
    assert all(0.5 < langid.script_language(t)[1] < 1 for t in (uk, ru))
    assert langid.script_language("Сосед купил")[1] <= 0.5
    assert langid.script_language("東の港で市が開かれる") == ("ja", 1.0) and langid.script_language("山水") == ("zh", 0.5)
    assert langid.script_language("همسایه سه دوچرخه خرید چون گربه پرید")[0] == "fa"
    assert langid.script_language("plain") == langid.script_language("") == (None, 0.0)


def test_segments_of_a_line(full_model):
    text = "The small museum opens its doors early in the morning, aber die Bäckerei braucht mehr Freiwillige für das kleine Fest."
    got = langid.segments(langid.Scorer(full_model), text)
    assert [g[2] for g in got] == ["en", "de"] and text[got[1][0] : got[1][1]].startswith("aber die") and all(g[3] > 0.9 for g in got)
    assert [g[2] for g in langid.segments(langid.Scorer(full_model), "The museum opens early in the morning.")] == ["en"]
    assert langid.segments(langid.Scorer(full_model), None) == langid.segments(langid.Scorer(full_model), " 7 ") == []


def test_long_words_count_whole(model):
    pieces, probs = model.pieces, model.probs
    word = langid._marked("gardener" * 5)
    short = np.log(langid._forward(1, langid._edges([word], pieces, model.longest), probs)[0, len(word)])
    assert np.allclose(langid._forward_long(word, pieces, model.longest, probs), short)
    s = langid.Scorer(model)
    logs, _ = s.words(["harbour" * 30 + "x", "harbour" * 30 + "y" * 200])
    assert np.isfinite(logs).all() and (logs[0] != logs[1]).all()


NODES = "page_id long, host_name string, node_id int, parent_id int, pos int, node_depth int, tag string, elem_id string, classes array<string>, attrs map<string,string>, text string, label string"
EN = ["The old harbour opens its doors again in the morning.", "The village library needs more volunteers, and every gardener measures rainfall in the valley.", "The small museum has found a forgotten map early in the morning."]
DE = "Der alte Hafen öffnet wieder seine Türen, und das kleine Museum hat eine vergessene Karte gefunden."


def page(k, body, host="h.example"):
    rows = [(k, host, 0, None, 0, 0, "html", None, [], {"lang": "en"}, None, "x"), (k, host, 1, 0, 0, 1, "body", None, [], {}, None, "x"), (k, host, 2, 1, 0, 2, "nav", None, [], {}, None, "x"), (k, host, 3, 2, 0, 3, "a", None, [], {"href": "/"}, "Home", "x"), (k, host, 4, 2, 1, 3, "a", None, [], {"href": "/c"}, "Contact", "x"), (k, host, 5, 1, 1, 2, "article", None, [], {}, None, "x")]
    for i, t in enumerate(body):
        rows.append((k, host, 6 + i, 5, i, 3, "h1" if not i else "p", None, [], {}, t, "x"))
    return [*rows, (k, host, 90, 1, 2, 2, "footer", None, [], {}, "Published by the association", "x")]


@pytest.fixture(scope="module")
def tables(spark):
    bodies = {k: [f"The museum story {chr(97 + k % 26)}{chr(97 + k // 26)}", *(EN[(k + j) % 3] for j in range(3))] for k in range(60)}
    bodies[60] = ["A story", EN[0], DE, EN[1]]
    bodies[61] = ["A story", f"{EN[0]} {{{{ name }}}}", EN[1]]
    bodies[62] = ["404 - the page you asked for was not found"]
    for k in range(63, 69):
        bodies[k] = ["zu deal sofa deal", " ".join(["deal", "sofa", f"lamp{k}", "deal", "buy", "buy"] * 12)]
    bodies[69] = [None, "", "  "]
    rows = [r for k, b in bodies.items() for r in page(k, b)]
    rows += [rows[7], (None, None, None, None, None, None, None, None, None, None, None, None)]
    nodes = spark.createDataFrame(rows, NODES)
    meta = spark.createDataFrame([(k, {1: None, 2: "de", 3: "en_GB"}.get(k, "en"), "[[t]]" if k == 5 else "A title") for k in bodies] + [(500, "en", "NaN")], "page_id long, langage string, title string")
    docs = spark.createDataFrame([(k, "\n".join(t for t in b if t) or None) for k, b in bodies.items()], "doc_id long, text string")
    samples = spark.createDataFrame(SAMPLES, "lang string, text string")
    repeated = spark.createDataFrame([(k, n) for k in bodies for n in (3, 4, 90)], "page_id long, node_id int")
    return nodes, meta, docs, samples, repeated


def test_pass(spark, tables):
    pages = pagepass.analyse(*tables, pagepass.Parts(True, True, True))
    got = {r.page_id: r for r in pages.collect()}
    assert len(got) == 71
    assert all(got[k].main == [6, 7, 8, 9] and got[k].lang == "en" and not got[k].foreign_nodes for k in range(60))
    assert (got[60].foreign_nodes, got[60].foreign_langs) == ([8], ["de"]) and got[60].foreign_confidence[0] > 0.9
    assert {k for k, r in got.items() if r.residue} == {5, 61, 62, 500}
    assert [got[k].label for k in (1, 2, 3)] == [None, "de", "en"]
    assert {k for k, r in got.items() if r.spam > 0.4} == set(range(63, 69))
    assert got[69].main == [] and got[69].lang is None
    scores = {r.page_id: r.score for r in pagepass.smoothed_spam(pages).collect()}
    assert min(scores[k] for k in range(63, 69)) > 0.4 > max(scores[k] for k in range(63))


def test_pass_over_nothing(spark, tables):
    nothing = [t.where("false") for t in tables]
    assert pagepass.analyse(*nothing, pagepass.Parts(True, True, True)).count() == 0
    untrained = pagepass.analyse(tables[0], tables[1], tables[2].where("false"), tables[3], tables[4], pagepass.Parts(True, True, True))
    assert all(not r.main for r in untrained.collect())


def main_lines(lines, flags=()):
    """The residue of a page whose lines are all main text but for the flagged ones."""
    import pyarrow as pa

    rows = page(1, lines)
    flagged = {3, 4, 90, *(6 + i for i in flags)}
    columns = {"page_id": [r[0] for r in rows], "node_id": [r[2] for r in rows], "parent_id": [r[3] for r in rows], "node_depth": [r[5] for r in rows], "tag": [r[6] for r in rows], "text": pa.array([r[10] for r in rows], pa.string()), "flag": [r[2] in flagged for r in rows]}
    p = pagepass.Pages(pa.table(columns))
    at = pagepass.mainbody.blocks(p)
    run = pagepass.Pass(pagepass.Learned(None, [], [], None), pagepass.Parts(residue=True))
    return run._residue(p, at, (p.node_id[at] >= 6) & ~p.flag[at], p.text.take(pa.array(at)), {}, p.page_id[p.start])[0]


def test_every_phrase_reaches_the_judge():
    missed = [t for t in residue.ERRORS + residue.SCRIPTS + residue.FILLER if not main_lines([t])]
    assert missed == []
    assert main_lines(["503 Service Unavailable", "The service is temporarily unavailable. Please try again later."])
    assert main_lines(["TODO TBD"]) and main_lines(["Page not found", "Ref " + "0b6e97f0 / " * 60])
    assert not main_lines(["The story", *EN])


def test_repeated_message_in_place_of_content():
    assert main_lines(["Service unavailable", "Ref 0b6e97f0 / 460"], flags=[0])
    assert main_lines(["{{ title }}"], flags=[0])
    assert not main_lines(["The story", *EN, "Please enable JavaScript to view this page", "{{ title }}"], flags=[4, 5])
    assert not main_lines(["Subscribe to our newsletter"], flags=[0])
