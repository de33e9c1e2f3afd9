import random
import re
import struct
import zlib

import numpy as np
import pytest
import sentencepiece

import corpus_pipeline
from gridloom.llm import decontam, html_extract, sp_tokens, toxicity
from gridloom.llm.queries import SP_MODEL

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, texts, ids=None):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in zip(ids or range(len(texts)), texts)], SCHEMA)


# HTML extraction

PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a="</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href=x>Menu</a></li></ul></nav><div class="cookie-notice">We use cookies, really, many of them, on this page.</div>
<aside>Side story, long enough to look like text, with commas, and more of them.</aside>
<article><h1>Head &amp; line</h1><p>First  paragraph, with\ncommas, and <b>bold<br>text</b>, quite long.<p>Second &lt;one&gt; &#233;, also long enough to count, surely.
<div class="ad">Buy now, buy cheap, buy a lot, buy everything here today.</div><form><input name=q>Search, here</form><ul><li>Item a<li>Item b</ul>
<section class="comments"><p>Reader says, I like this, it is long and has commas, yes.</p></section></article>
<footer>&copy; us</footer></body></html>"""


def test_main_text_of_a_page():
    assert html_extract.main_text(PAGE).split("\n") == ["Head & line", "First paragraph, with commas, and bold text, quite long.", "Second <one> é, also long enough to count, surely.", "Item a", "Item b"]


def test_best_container_without_article():
    page = "<div id=menu><a href=1>one</a></div><div><div class=story><p>" + "A long sentence, with commas, and words. " * 4 + "</p><p>" + "More of the same, and more, and more. " * 4 + "</p></div><div><a href=2>link, link, link, link, link, link</a></div></div>"
    text = html_extract.main_text(page)
    assert text.count("\n") == 1 and "link" not in text and "one" not in text


@pytest.mark.parametrize("page", ["", None, "   ", "<", "<<<>>>", "<p", "</div></p>", "<!-- x", "<script>alert(1)", "&am", "<a href='x", "<table><tr><td>cell<td>other</table>", "<p>" * 500])
def test_odd_pages_do_not_crash(page):
    assert isinstance(html_extract.main_text(page), str)


BODY = "<p>" + "A long sentence, with commas, and words. " * 4 + "</p>"


def around(inner):
    return f"<html><head><title>t</title><body><nav><a href=x>m</a></nav><article><h1>T</h1>{BODY}{inner}{BODY}</article><footer>f</footer></body></html>"


@pytest.mark.parametrize("name", ["article-comments", "comment", "commentList", "sidebar-content", "main-menu", "ad-slot", "share-buttons", "cookie-notice", "newsletter-signup", "related-posts", "nav-links", "hidden"])
def test_unwanted_parts_of_an_article_go(name):
    for attribute in ("class", "id", 'data-x="y" class'):
        assert "INNER" not in html_extract.main_text(around(f'<div {attribute}="x {name}"><p>INNER text of this part, long enough to count, and so on, and so on.</p></div>'))


@pytest.mark.parametrize("name", ["share-price", "legal-news", "market-share", "has-sidebar", "article-header", "entry-content", "ad-hoc", "story"])
def test_wanted_parts_of_an_article_stay(name):
    assert "INNER" in html_extract.main_text(around(f'<div class="{name}"><p>INNER text of this part, long enough to count, and so on, and so on.</p></div>'))
    assert "INNER" in html_extract.main_text(around(f'<div data-class="comments" data-id="nav" title="menu"><p>INNER {name}, and so on.</p></div>'))


def test_parts_by_element_and_role():
    for part in ("<article class=comment><p>INNER</p></article>", "<div role=navigation>INNER</div>", "<p hidden>INNER</p>", "<p style='display: none'>INNER", "<form><p>INNER</p></form>", "<div itemprop=comment>INNER</div>", "<button>INNER</button>"):
        assert html_extract.main_text(around(part)) == html_extract.main_text(around(""))
    assert "one two three" in html_extract.main_text(around("<p>one <svg><g>x</g></svg>two <b>three"))
    assert html_extract.main_text("<form>" + BODY * 4 + "</form>").count("\n") == 3  # a frame around the page
    links = "<div class=widget>" + "<a href=x>INNER link, more of it</a> " * 20 + "</div>"
    assert "INNER" not in html_extract.main_text(around(links)) and "INNER" in html_extract.main_text(around(f"<div class=widget><p>INNER{BODY * 3}</p></div>"))


def test_head_without_end_and_anchors():
    assert html_extract.main_text(f"<html><head><title>t</title><p>Text, in full.{BODY}").startswith("Text, in full.")
    assert "named" in html_extract.main_text(around("<a name=top><p>named anchor, no link, so it counts, and stays.</p>"))
    assert html_extract.main_text("a &#" + "9" * 6000 + "; b") == "a \ufffd b"
    assert html_extract.main_text(f"<main><h1>Head</h1><article>{BODY}</article></main>").startswith("Head\n")


HARD = {"open tags": "<a " * 330_000, "deep": "<div>" * 100_000, "headings": "<h1>x" * 100_000, "buttons": "<p><button>" + "<h2>x" * 50_000, "quotes": '<a b="' * 150_000, "ends": "</x>" * 200_000, "lists": "<ul><li>" * 50_000, "signs": "<" * 300_000, "comments": "<!--" * 200_000, "spaces": "<a =" + " " * 300_000}


@pytest.mark.parametrize("name", HARD)
def test_hard_pages_take_linear_time(name):
    import time

    began = time.process_time()
    html_extract.main_text(HARD[name])
    assert time.process_time() - began < 4


def plain_extract(tree):
    """A second, recursive reading of the scoring: tree = (tag, text, share of link text, children)."""
    nodes = []

    def walk(node, up):
        me = len(nodes)
        nodes.append((node, up))
        for child in node[3]:
            walk(child, me)

    walk(tree, None)

    def total(i, what):
        return what(nodes[i][0]) + sum(total(j, what) for j, (_, up) in enumerate(nodes) if up == i)

    points = [0.0] * len(nodes)
    for i, ((tag, text, linked, _), up) in enumerate(nodes):
        if len(text) >= 25:
            gain = (1 + text.count(",") + min(len(text) // 100, 3)) * (1 - (1 if linked else 0))
            chain, at = [], up if tag == "p" else i
            while at is not None and len(chain) < 5:
                chain.append(at)
                at = nodes[at][1]
            for level, a in enumerate(chain):
                points[a] += gain / [1, 2, 6, 9, 12][level]
    size = [total(i, lambda n: len(n[1])) for i in range(len(nodes))]
    link = [total(i, lambda n: len(n[1]) if n[2] else 0) for i in range(len(nodes))]
    score = [points[i] * (1 - link[i] / size[i]) if size[i] else 0.0 for i in range(len(nodes))]
    best = max(range(len(nodes)), key=lambda i: (score[i], -i))
    roots = {best} | {i for i, (n, up) in enumerate(nodes) if score[best] > 0 and up == nodes[best][1] and (score[i] >= max(10.0, score[best] * 0.2) and n[0] == nodes[best][0][0] or n[0] == "p" and size[i] > 80 and link[i] * 4 < size[i])}
    if score[best] <= 0:
        roots = {0}
    kept = []
    for i, (node, _) in enumerate(nodes):
        at = i
        while at is not None and at not in roots:
            at = nodes[at][1]
        if at is not None and node[1]:
            kept.append(node[1])
    return "\n".join(kept)


def test_scoring_is_the_plain_one():
    rng = random.Random(11)

    def grown(depth):
        kind = rng.choice(["div", "section", "p"]) if depth else "div"
        if kind == "p" or depth > 4:
            n = rng.randint(1, 40)
            return ("p", " ".join(rng.choice(["word", "word,", "longer"]) for _ in range(n)), rng.random() < 0.25, [])
        return (kind, "", False, [grown(depth + 1) for _ in range(rng.randint(1, 4))])

    def written(node):
        tag, text, linked, children = node
        return f"<{tag}>{'<a href=x>' * linked}{text}{'</a>' * linked}{''.join(map(written, children))}</{tag}>"

    for _ in range(300):
        tree = ("#page", "", False, [grown(0)])
        assert html_extract.main_text(written(tree[3][0])) == plain_extract(tree)


def test_plain_text_and_empty_text():
    assert html_extract.main_text("just words &amp; more") == "just words & more"
    assert html_extract.main_text("<nav>only a menu</nav>") == ""


def test_pages_of_the_fixture(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r for r in html_extract.extract_pages(pages.withColumnRenamed("html", "html")).collect()}
    for p in pages.collect():
        body = re.search(r"<article>(.*?)(?:</article>|\Z)", p.html, re.S)[1]
        import html

        want = [" ".join(html.unescape(re.sub(r"<br[^>]*>", " ", x).replace("<b>", "").replace("</b>", "")).split()) for x in re.split(r"</?(?:p|h1)>", body)]
        assert got[p.page_id].text == "\n".join(w for w in want if w) and got[p.page_id].n_chars == len(got[p.page_id].text)
    odd = spark.createDataFrame([(1, None, None, "z"), (1, "u", "<p>a</p>", "z")], "page_id long, url string, html string, text string")
    assert sorted((r.page_id, r.url, r.text, r.n_chars) for r in html_extract.extract_pages(odd).collect() if r.url) == [(1, "u", "a", 1)]
    assert html_extract.extract_pages(odd.limit(0)).count() == 0


# SentencePiece

TEXTS = ["Hello  world", " lead and trail ", "a\n\nb\tc", "日本語 🙂 ñandú ÄÖ", "<s> </s> <unk> <0x0A>", "x" * 300, "▁mark ▁", "", None, "aaaa aaaaa aaaaaaa", "é" * 40 + "́"]


def test_tokens_are_those_of_sentencepiece(spark):
    rows = sp_tokens.encode_texts(frame(spark, TEXTS), SP_MODEL).collect()
    sp = sentencepiece.SentencePieceProcessor(model_file=SP_MODEL)
    assert len(rows) == len(TEXTS)
    for r in rows:
        t = TEXTS[r.doc_id] or ""
        assert r.parity and list(r.token_ids) == sp.encode(t) and r.n_tokens == len(r.token_ids)
        assert r.round_trip == ("▁" not in t) and r.text == TEXTS[r.doc_id]
    again = sp_tokens.encode_texts(sp_tokens.encode_texts(frame(spark, TEXTS), SP_MODEL), SP_MODEL, verify=False)
    assert again.columns == [*frame(spark, []).columns, "token_ids", "n_tokens", "parity", "round_trip"] and again.where("parity is not null").count() == 0
    assert sp_tokens.encode_texts(frame(spark, []), SP_MODEL).count() == 0


def test_decoding_by_words_is_that_of_whole_texts():
    """Word by word, by the library on whole lists of ids and by SentencePiece."""
    with open(SP_MODEL, "rb") as f:
        data = f.read()
    own, sp = sp_tokens.BatchEncoder(sp_tokens.SpModel(data)), sentencepiece.SentencePieceProcessor(model_proto=data)
    rng = random.Random(7)
    parts = ["the", "Wort", " ", "  ", "\n", "▁", "ñ", "日本", "🙂", "\t", "x" * 40, "<0x41>", "</s>", "\x00", "é"]
    texts = ["".join(rng.choice(parts) + rng.choice(["", " "]) for _ in range(rng.randint(0, 30))) for _ in range(400)] + [t or "" for t in TEXTS]
    for t, e in zip(texts, own(texts)):
        ids = e.tolist()
        assert ids == sp.encode(t) and len(e) == len(ids)
        assert e.text == own.tokenizer.decode(ids, skip_special_tokens=False) == sp.decode(ids)
    own.odd = {"▁the": " THE"}  # what the library decodes a word to is what counts
    assert own(["the cat"])[0].text == "THE cat"


def _field(number, value):
    if isinstance(value, bytes):
        return bytes([number << 3 | 2]) + (bytes([len(value)]) if len(value) < 128 else bytes([len(value) & 127 | 128, len(value) >> 7])) + value
    tag = number << 3
    return (bytes([tag]) if tag < 128 else bytes([tag & 127 | 128, tag >> 7])) + bytes([value])


def _model(kind, pieces):
    body = b"".join(_field(1, _field(1, p.encode()) + bytes([2 << 3 | 5]) + struct.pack("<f", s) + _field(3, k)) for p, s, k in pieces)
    return body + _field(2, _field(3, kind) + _field(35, 1)) + _field(3, _field(1, b"identity") + _field(3, 1) + _field(4, 0))


def test_unigram_models_agree_too():
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(f"<0x{i:02X}>", -20.0, 6) for i in range(256)]
    pieces += [(p, -2.0 - i / 7, 1) for i, p in enumerate(["▁", "a", "b", "ab", "▁a", "ba", "aba", "▁ab", "c", "abc"])]
    data = _model(sp_tokens.UNIGRAM, pieces)
    sp, own = sentencepiece.SentencePieceProcessor(model_proto=data), sp_tokens.BatchEncoder(sp_tokens.SpModel(data))
    rng = random.Random(1)
    texts = ["".join(rng.choice("abc  ") for _ in range(rng.randint(0, 20))) for _ in range(60)] + ["zé a"]
    assert [e.tolist() for e in own(texts)] == sp.encode(texts)
    assert [e.text for e in own(texts)] == texts
    with pytest.raises(ValueError):
        sp_tokens.build_tokenizer(sp_tokens.SpModel(_model(4, pieces)))


# Decontamination


def edit_best(pattern, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(pattern):
        new = [i + 1]
        for j, b in enumerate(text):
            new.append(min(row[j] + (a != b), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def test_myers_is_the_edit_distance():
    rng = random.Random(3)
    for _ in range(200):
        p, t = ("".join(rng.choice("abc") for _ in range(n)) for n in (rng.randint(1, 90), rng.randint(0, 120)))
        want, got = edit_best(p, t), decontam.myers_best(p, t, len(p))
        assert (got[0] if got else len(p)) == want or want == len(p)
        cut = decontam.myers_best(p, t, want - 1) if want else None
        assert cut is None


def test_contamination_is_the_brute_force(spark):
    rng = random.Random(4)
    text = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    items = [(i, text(rng.randint(40, 120))) for i in range(12)] + [(50, None), (51, " !"), (52, "")]
    docs = [text(200) for _ in range(30)]
    for i in range(25):
        body = list(items[i % 12][1])
        for _ in range(rng.randint(0, 8)):
            at = rng.randrange(len(body))
            body[at : at + rng.randint(0, 1)] = rng.choice("xyz ")
        docs.append(text(50) + "".join(body).upper() + text(30))
    items += [(60, "xyzzy"), (61, "Ñandú ñ")]
    docs += [None, "", items[0][1].replace(" ", "  \n"), "Straße " + items[1][1], "ñ ñandú xyzzy", "plugh " * 40_000 + items[2][1] + "é " * 300, "öö ñandú  Ñ"]
    found = decontam.contaminated(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string"), 0.05)
    got = {(r.doc_id, r.item_id): r.distance for r in found.collect()}
    want = {}
    for d, t in enumerate(docs):
        for i, x in items:
            if p := decontam.normalised(x or ""):
                best = edit_best(p, decontam.normalised(t or ""))
                if best <= int(len(p) * 0.05) and t:
                    want[d, i] = best
    assert got == want and len(want) > 12
    for size in (decontam.ITEM_BYTES, 200):  # both ways
        named = spark.createDataFrame([(f"item {i}", x) for i, x in items] + [("again", items[0][1])], "item_id string, text string")
        again = decontam.contaminated(frame(spark, docs + docs[:40], [*range(len(docs)), *[None] * 40]), named, 0.05, item_bytes=size).collect()
        assert {(r.doc_id, r.item_id): r.distance for r in again if r.doc_id is not None and r.item_id != "again"} == {(d, f"item {i}"): n for (d, i), n in want.items()}
        assert sum(r.doc_id is None for r in again) == sum(1 + (i == 0) for d, i in want if d < 40) and {r.doc_id for r in again if r.item_id == "again"} >= {d for d, i in want if i == 0}
        clash = frame(spark, docs).withColumnRenamed("lang", "key").withColumnRenamed("source", "item_id")
        kept = decontam.drop_contaminated(clash, spark.createDataFrame(items, "item_id long, text string"), item_bytes=size)
        assert sorted(r.doc_id for r in kept.collect()) == sorted(set(range(len(docs))) - {d for d, _ in want}) and kept.columns == clash.columns
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontam.contaminated(frame(spark, docs), empty).count() == 0
    assert decontam.contaminated(frame(spark, []), empty).count() == 0


# Toxicity


def adds(text):
    """What the grammar adds over all clauses, insults by number of words."""
    words = {w: (symbol, 1.0) for w, (symbol, _) in toxicity.lexicon().items()}
    return np.sum(toxicity.Matcher(words).clauses(text) or [[0.0] * 6], axis=0)


def test_grammar_tells_clauses_apart():
    told = lambda text, what: adds(text)[what]
    assert told("You are an idiot.", toxicity.DIRECTED) == told("Idiot, that is what you are.", toxicity.DIRECTED) == told("You’re an idiot.", toxicity.DIRECTED) == 1
    assert told("What an idiot.", toxicity.INSULTED) == 1 and told("What an idiot.", toxicity.DIRECTED) == 0
    assert told("She is not stupid.", toxicity.DENIED) == told("She isn't stupid.", toxicity.DENIED) == 1 and told("She isn't stupid.", toxicity.INSULTED) == 0
    assert told("He said you are an idiot.", toxicity.QUOTED) == 1 and told("He said you are an idiot.", toxicity.DIRECTED) == 0
    for menace in ("I will kill you.", "I'll kill you", "I’ll hang them all", "Ich werde dich schlagen, ich werde töten dich"):
        assert told(menace, toxicity.MENACED) == 1
    for harmless in ("I will not kill you.", "We will hang the pictures.", "I will kill the background process.", "You hang around", "He said he will kill you"):
        assert told(harmless, toxicity.MENACED) == 0
    assert not adds("A kind word.").any() and not adds("I am ill, you know").any()
    assert told("He said so. You are an idiot.", toxicity.DIRECTED) == 1


def plain_adds(symbols, weights):
    """Brute force: each symbol looks back and ahead over the whole clause."""
    n, total = len(symbols), [0.0] * 6
    before = lambda s, i, reach: s in symbols[max(0, i - reach) : i]
    for i in range(n):
        if symbols[i] == "i":
            kind = toxicity.DENIED if before("n", i, 3) else toxicity.QUOTED if before("r", i, 8) else toxicity.INSULTED
            total[kind] += weights[i]
    kept = ["-" if s in "it" and (before("n", i, 3) or before("r", i, 8)) else s for i, s in enumerate(symbols)]
    waiting, near = -1, -1  # the last insult not directed yet, the last target
    for i, s in enumerate(kept):
        if s == toxicity.TARGET:
            total[toxicity.DIRECTED] += 0 <= waiting and i - waiting <= 5
            near, waiting = i, -1
        elif s == toxicity.INSULT:
            if near >= 0 and i - near <= 4:
                total[toxicity.DIRECTED] += 1
                waiting = -1
            else:
                waiting = i
    for i, s in enumerate(kept):
        total[toxicity.THREATENED] += s == toxicity.THREAT
        if s == toxicity.TARGET:
            last = max((j for j in range(max(0, i - 3), i) if kept[j] == toxicity.THREAT and toxicity.INTENT in kept[max(0, j - 3) : j]), default=-1)
            total[toxicity.MENACED] += last >= 0 and toxicity.TARGET not in kept[last + 1 : i]
    return total


def test_composed_grammar_is_the_brute_force():
    rng = random.Random(5)
    symbols = "".join((toxicity.INSULT, toxicity.THREAT, toxicity.TARGET, toxicity.NEGATION, toxicity.REPORT, toxicity.INTENT)) + toxicity.OTHER * 4
    grammar = toxicity.Composed(toxicity.GRAMMAR)
    for _ in range(3000):
        line = [rng.choice(symbols) for _ in range(rng.randint(1, 24))]
        weights = [rng.choice([0.5, 1.0, 3.0]) for _ in line]
        assert list(grammar(line, weights)) == pytest.approx(plain_adds(line, weights)), line


def test_scores_rest_on_the_grammar():
    same = toxicity.Transducer(0, lambda state, symbol: (0, symbol, (toxicity.INSULTED,) if symbol == toxicity.INSULT else ()))
    texts = ["You are an idiot.", "She is not an idiot.", "He said she is an idiot.", "What an idiot.", "I will kill you."]
    with_grammar, words_alone = ([toxicity.joined(toxicity.Matcher(toxicity.lexicon(), m).clauses(t), toxicity.PRIOR) for t in texts] for m in (toxicity.GRAMMAR, same))
    assert with_grammar[0] > with_grammar[3] > 2 * max(with_grammar[1:3]) and with_grammar[4] > 0.5
    assert len(set(words_alone[:4])) == 1 and words_alone[4] < 0.1


def test_arc_weights_are_learned():
    rng = random.Random(9)
    clause = lambda *at: tuple(3.0 if i < 1 and i in at else float(i in at) for i in range(6))
    texts = [([clause(0, 3)], 1) for _ in range(60)] + [([clause(0)], int(rng.random() < 0.1)) for _ in range(200)] + [([], 0)] * 50
    w = toxicity.fitted(texts)
    assert w[1 + toxicity.DIRECTED] > toxicity.PRIOR[1 + toxicity.DIRECTED] + 0.5
    assert toxicity.joined([clause(0, 3)], w) > 0.7 and toxicity.joined([clause(0)], w) < 0.3
    assert (toxicity.fitted([]) == toxicity.PRIOR).all() and toxicity.joined([], w) == toxicity.GROUND


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.toxicity_scores(docs, labels)
    rows = got.join(docs.select("doc_id", "lang"), "doc_id").join(labels, "doc_id").where("held_out").collect()
    for lang, least in (("en", 0.85), ("de", 0.85), ("fr", 0.85), ("es", 0.5)):  # 22 toxic documents teach Spanish
        own = [r for r in rows if r.lang == lang]
        hit = sum(r.predicted and r.toxic for r in own)
        assert hit / sum(r.toxic for r in own) > least and sum(r.predicted and not r.toxic for r in own) <= 0.05 * len(own), lang
    for r in got.limit(50).collect():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1


def test_scores_of_odd_tables(spark):
    docs = frame(spark, [None, "", "you idiot, you moron, you loser, you scum.", "You idiot", "idiot " * 30_000], [1, None, 3, 3, 4])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = toxicity.toxicity_scores(docs, none).collect()
    assert len(rows) == 5 and not [r for r in rows if r.doc_id is None][0].held_out
    assert [r.predicted for r in rows if r.doc_id in (3, 4)] == [1, 1, 1] and [r.predicted for r in rows if r.doc_id in (1, None)] == [0, 0]
    assert toxicity.toxicity_scores(frame(spark, []), none).count() == 0
    labels = spark.createDataFrame([(3, None, None), (3, 1, 1), (1, 0, 0), (None, 1, 1), (1, 0, 5)], "doc_id long, quality int, toxic int")
    assert toxicity.toxicity_scores(docs, labels).count() == 5
    clash = docs.withColumnRenamed("lang", "score").withColumnRenamed("source", "_score")
    assert toxicity.drop_toxic(clash, labels).columns == clash.columns
    kept = toxicity.drop_toxic(clash, labels).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in kept) == [(0, ""), (1, "")] and {r.score for r in kept} == {"en"}


# Pipeline


def test_pipeline_is_its_stages(spark):
    """Each stage against brute force on its own input."""
    from test_basic_ops import plain_lines
    from test_near_copies import groups

    read = lambda df: {r.doc_id: r for r in df.collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first = corpus_pipeline.toxicity(spark, docs, SF)
    scores = {r.doc_id: r.score for r in toxicity.toxicity_scores(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    assert set(read(first)) == {d for d, s in scores.items() if s < 0.3} and first.columns == docs.columns
    one = read(first)
    second = corpus_pipeline.line_dedup(spark, first, SF)
    two = read(second)
    want = plain_lines([one[d].text for d in one], 10)
    import hashlib

    assert {d: hashlib.sha256(r.text.encode()).hexdigest() for d, r in two.items()} == {d: w[2] for d, w in zip(one, want)}
    assert all(r.n_chars == len(r.text) for r in two.values()) and second.columns == docs.columns
    third = corpus_pipeline.simhash(spark, second, SF)
    ids = sorted(two)
    label = groups([two[d].text for d in ids])
    assert set(read(third)) == {d for i, d in enumerate(ids) if label[i] == i} and third.columns == docs.columns
    three = read(third)
    fourth = corpus_pipeline.decontamination(spark, third, SF)
    bench = [decontam.normalised(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    grams = lambda t: {t[i : i + 8] for i in range(len(t) - 7)}
    own, bad = [(b, int(len(b) * 0.05), grams(b)) for b in bench], set()
    for d, r in three.items():
        plain = decontam.normalised(r.text)
        seen = grams(plain)
        # Of budget + 1 parts one survives any edits, and it has eight characters at least.
        if any(len(b) // (k + 1) < 8 or not g.isdisjoint(seen) and edit_best(b, plain) <= k for b, k, g in own):
            bad.add(d)
    assert set(three) - set(read(fourth)) == bad and bad and fourth.columns == docs.columns
    last = corpus_pipeline.sentencepiece(spark, fourth, SF).collect()
    assert {r.doc_id for r in last} == set(read(fourth)) and all(r.parity and r.round_trip for r in last)
    whole = corpus_pipeline.run(spark, SF)
    assert {r.doc_id: r.n_tokens for r in whole.collect()} == {r.doc_id: r.n_tokens for r in last}
