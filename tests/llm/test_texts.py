"""Ranking, markup, packing, leaks, encodings and neighbours: brute force, literal cases, round trips."""

import itertools
import math
import random
import re
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lorevine.llm import fuse, leaks, markup, mojibake, neighbours, packing

TOKENIZER = Path(packing.TOKENIZERS, "byte_bpe_50k.tiktoken")


# ---- one ranking

def wide(spark, rows):
    return spark.createDataFrame(rows, "g string, item string, a double, b double").withColumn("below", F.lit("clash"))


def test_percentiles_and_order(spark):
    rows = [("q", "x", 1.0, 5e9), ("q", "y", 2.0, -3e9), ("q", "z", 2.0, None), ("q", "n", float("nan"), 1.0), (None, "o", 1.0, 1.0)]
    got = {r.item: r for r in fuse.ranked(fuse.fused(wide(spark, rows), "g", "item", ["a", "b"]), "g", "item").collect()}
    normal = {p: got[i].z_a for i, p in (("n", 0.125), ("x", 0.375), ("y", 0.75))}
    assert got["y"].z_a == got["z"].z_a
    for p, z in normal.items():
        assert abs(0.5 * (1 + math.erf(z / math.sqrt(2))) - p) < 1e-6
    assert sorted(r.rank for r in got.values() if r.g == "q") == [1, 2, 3, 4] and got["o"].rank == 1 and got["o"].fused == pytest.approx(0)


def test_scale_does_not_matter(spark):
    rows = [("q", f"i{i}", float(i % 7), float((i * 5) % 11)) for i in range(30)]
    one = fuse.fused(wide(spark, rows), "g", "item", ["a", "b"])
    two = fuse.fused(wide(spark, [(g, i, a * 1e6 + 3, b) for g, i, a, b in rows]), "g", "item", ["a", "b"])
    key = lambda df: {r.item: round(r.fused, 9) for r in df.collect()}
    assert key(one) == key(two)


@pytest.mark.parametrize("fold", [3, 512])
def test_leaders_by_brute_force(spark, monkeypatch, fold):
    monkeypatch.setattr(fuse, "FOLD", fold)
    rng = random.Random(5)
    rows = [(f"g{g}", f"i{i}", rng.choice([None, 1.0, 2.0, 3.0, 9.0]), float(rng.randrange(5))) for g in range(25) for i in range(1 + g % 12)]
    value = lambda x: -math.inf if x is None else x
    want = set()
    for g, group in itertools.groupby(rows, key=lambda r: r[0]):
        group = list(group)
        for r in group:
            if all(sum((value(x) > value(y)) - (value(x) < value(y)) for x, y in zip(r[2:], s[2:], strict=True)) > 0 for s in group if s is not r):
                want.add((g, r[1]))
    got = fuse.leaders(fuse.fused(wide(spark, rows), "g", "item", ["a", "b"]), "g", "item", ["a", "b"]).collect()
    assert {(r.g, r.item) for r in got} == want and len(got) == len(want)
    assert fuse.leaders(fuse.fused(wide(spark, []), "g", "item", ["a", "b"]), "g", "item", ["a", "b"]).count() == 0


def test_search_scores(spark):
    hits = spark.createDataFrame([(1, "keyword", "a", 1.0), (1, "keyword", "a", 3.0), (1, "keyword", "b", float("nan")), (1, "rerank", "b", float("-inf")), (1, "semantic", "c", None), (None, "keyword", "a", 1.0), (1, "keyword", None, 1.0)], "query_id long, list_name string, id string, score double")
    notes = spark.createDataFrame([("a", 99), ("b", None)], "id string, importance int")
    got = {r.id: (r.keyword, r.semantic, r.rerank, r.importance) for r in fuse.search_scores(hits, notes, ["keyword", "semantic", "rerank"]).collect()}
    assert got == {"a": (3.0, None, None, 10.0), "b": (None, None, None, 0.0), "c": (None, None, None, 0.0)}


# ---- markup

def test_long_formula():
    formula = "$" + " + ".join(f"a_{i}" for i in range(150)) + "$"
    assert len(formula) > 1000 and markup.clean(f"So {formula} holds.") == (f"So {formula} holds.", {"latex mathematics"})
    prices = "From $5 " + "and more words " * 60 + "up to $10, all of it text."
    assert markup.clean(prices) == (prices, set())


@pytest.mark.parametrize("text", ["a < b and c > d", "x <b yields> y", "R&D for $5 to $9", "2 * 3 * 4", "issue #74 at a_b_c", "C:\\dir\\alpha \\\\host\\share", "path a.b\\alpha\\beta", "f(x) = 3x + 2 (see [33])", "2.0 ~ 15", "plain\nlines - with dashes", "5 > 3\nit's 'fine'", ""])
def test_plain_text_has_no_markup(text):
    assert markup.clean(text) == (text, set())


@pytest.mark.parametrize(("text", "kind", "want"), [
    ("# Head\n\nsome text", "markdown heading", "# Head\n\nsome text"), ("Head\n====\nsome text", "markdown heading", "# Head\nsome text"), ("== Head ==\nsome text", "wiki heading", "## Head\nsome text"), ("<h2 class='x'>Head</h2>\n<p>some text</p>", "html tag", "## Head\n\nsome text"),
    ("\\section{Head}\nsome \\emph{bold} text", "latex command", "## Head\n\nsome bold text"), ("some **bold** text", "markdown emphasis", "some bold text"), ("some _soft_ text", "markdown emphasis", "some soft text"), ("some ~~old~~ text", "markdown strike", "some old text"),
    ("call `f(x)` now", "markdown code", "call `f(x)` now"), ("```py\nx = [1](2)\n```", "markdown code", "```\nx = [1](2)\n```"), ("<pre><code>a &lt; b</code></pre>", "html tag", "```\na < b\n```"), ("* one item\n* two items", "markdown list", "- one item\n- two items"),
    ("<ul><li>one item</li><li>two items</li></ul>", "html tag", "- one item\n\n- two items"), ("> quoted text here", "markdown quote", "quoted text here"), ("see [the page](a_b.md \"t\")", "markdown link", "see the page"), ("see [[x/y|the page]]", "wiki link", "see the page"),
    ("| a | b |\n|---|---|\n| 1 | 2 |", "markdown table", "a | b\n1 | 2"), ("{|\n|-\n| a || b\n|}", "wiki table", "a | b"), ("some '''bold''' text", "wiki emphasis", "some bold text"), ("note {{status|early}} here", "wiki template", "note  here"), ("so $x_i^2$ holds", "latex mathematics", "so $x_i^2$ holds"),
    ("<math>\\frac{a}{b}</math>", "wiki mathematics", "$\\frac{a}{b}$"), ("\\begin{itemize}\\item one item\\end{itemize}", "latex environment", "- one item"), ("text <!-- gone --> text", "html comment", "text  text"), ("R&amp;D &middot; more", "html entity", "R&D · more"), ("\\[ a < b \\]", "latex mathematics", "$a < b$")])
def test_markup(text, kind, want):
    clean, kinds = markup.clean(text)
    assert kind in kinds
    assert markup.line_blocks(clean) == want


def test_line_blocks_drop_residue():
    assert markup.line_blocks("|\n\n}\n\n\n\nThis is a sentence of prose.\nAnother one follows it.\n\n\n\n\n.\n") == "This is a sentence of prose.\nAnother one follows it."
    assert markup.line_blocks("") == ""


PROSE_LINES = ["The gateway keeps a budget for each client and lowers it whenever the queue behind it grows faster than it can be drained.", "When the budget is spent, requests wait in a second queue, whose length is shown on the dashboard of the team.",
               "Operators may raise the budget for a while, but the change is logged and ends after an hour at the latest."]


def test_line_blocks_drop_menus():
    page = "<html><body><ul><li><a href='/'>Home</a></li><li><a href='/docs'>Docs</a></li><li><a href='/blog'>Blog</a></li><li><a href='/about'>About us</a></li><li><a href='/in'>Log in</a></li></ul>\n<h1>Budgets</h1>\n<p>" + "</p>\n<p>".join(PROSE_LINES)
    page += "</p>\n<ul><li>first case</li><li>second case</li></ul>\n<p>Thanks!</p>\n<div>Share</div>\n<div>Tweet</div>\n<div>Print</div>\n</body></html>"
    text = markup.line_blocks(markup.clean(page)[0])
    for gone in ("Home", "Docs", "About us", "Log in", "Share", "Tweet", "Print"):
        assert gone not in text
    for kept in ("# Budgets", *PROSE_LINES, "- first case", "- second case", "Thanks!"):
        assert kept in text


@pytest.mark.parametrize("note", ["call Anna\nbuy milk\nfix roof", "# Today\n- [[inbox]]\n- [[plans|next]]\n- [[people/anna]]", "See [one](a.md)\nand [two](b.md)", "## Related\n\n- [[a]]\n- [[b]]\n- [[c]]\n\n" + "\n".join(PROSE_LINES), PROSE_LINES[0] + "\nok\n" + PROSE_LINES[1] + PROSE_LINES[2]])
def test_line_blocks_keep_notes(note):
    kept = markup.line_blocks(markup.clean(note)[0])
    for word in re.findall(r"[A-Za-z]{2,}", re.sub(r"\([^)]*\)|\[\[[^|\]]*\|", "", note)):
        assert word in kept


def test_code_is_untouched():
    code = "if a &lt; b &amp;&amp; c:\n    x = '&copy;'  # [[link]] **b** {{t}}"
    for fence in ("```\n{}\n```", "~~~py\n{}\n~~~", "\\begin{{verbatim}}\n{}\n\\end{{verbatim}}"):
        assert code in markup.line_blocks(markup.clean("Text before.\n" + fence.format(code) + "\nText after.")[0])


def test_nesting_has_no_bound():
    assert markup.clean("a {{box|{{inner|{{deep|x}}}}| y}} b")[0] == "a  b"
    deep = "word"
    for _ in range(9):
        deep = "\\emph{" + deep + "}"
    assert markup.clean(f"one {deep} two")[0] == "one word two"


def test_markup_table(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "**b** " * 20_000), (3, "x")], "key long, kinds string").withColumn("clean_text", F.lit(1))
    got = [(r.key, r.clean_text if r.clean_text is None or len(r.clean_text) < 9 else len(r.clean_text), r.kinds) for r in markup.cleaned(df, "key", "kinds").collect()]
    assert sorted(got, key=str) == sorted([(1, None, []), (2, "", []), (3, 39_999, ["markdown emphasis"]), (3, "", [])], key=str)


@given(st.text(max_size=300))
@settings(max_examples=150, deadline=None)
def test_markup_never_fails(text):
    markup.line_blocks(markup.clean(text)[0])


# ---- packing

@given(st.lists(st.integers(1, 50), max_size=80))
@settings(max_examples=150, deadline=None)
def test_first_fit_decreasing(sizes):
    sizes.sort(reverse=True)
    bins, want = [], []
    for s in sizes:
        at = next((i for i, room in enumerate(bins) if room >= s), None)
        if at is None:
            bins.append(50)
            at = len(bins) - 1
        bins[at] -= s
        want.append(at)
    assert packing.first_fit_decreasing(sizes, 50) == want


def test_packed(spark):
    rng = random.Random(2)
    rows = [(i, rng.randrange(1, 90)) for i in range(300)] + [(1000, 250), (1001, 0), (1002, None), (5, 17), (5, 17), (1003, 100)]
    got = packing.packed(spark.createDataFrame(rows, "key long, n_tokens long"), 100, 64).collect()
    bins = {}
    for r in got:
        bins.setdefault((r.bin_group, r.bin), []).append(r.n_tokens)
    assert max(map(sum, bins.values())) <= 100
    assert sum(r.n_tokens for r in got) == sum(n or 0 for _, n in rows)
    assert sorted(r.n_tokens for r in got if r.key == 1000) == [50, 100, 100] and not [r for r in got if r.key in (1001, 1002)]
    assert sum(r.key == 5 and r.n_tokens == 17 for r in got) == 2 + (dict(rows[:300])[5] == 17)
    assert sum(map(sum, bins.values())) / (100 * len(bins)) > 0.93
    assert packing.packed(spark.createDataFrame([], "key long, n_tokens long"), 100).count() == 0
    with pytest.raises(ValueError):
        packing.packed(spark.createDataFrame(rows, "key long, n_tokens long"), 0)


@pytest.mark.skipif(not TOKENIZER.exists(), reason="no tokenizer files")
def test_token_counts(spark):
    text = "The gateway's naïve budget, 42 漢字.\n\n" * 6000
    enc = packing.encoder(str(TOKENIZER))
    assert packing.token_count(text, str(TOKENIZER)) == len(enc.encode_ordinary(text))
    df = spark.createDataFrame([(1, "two words"), (2, None), (3, ""), (None, "x")], "key long, t string")
    assert {r.key: r.n_tokens for r in packing.sized(df, "key", "t").collect()} == {1: 2, 2: 0, 3: 0}


# ---- leaks

def grams(text):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    return set(zip(*[w[i:] for i in range(5)], strict=False))


@pytest.mark.parametrize(("piece", "sent", "bits"), [(500_000, 500_000, 1 << 29), (40, 0, 1 << 16)])
def test_leaks_by_brute_force(spark, monkeypatch, piece, sent, bits):
    monkeypatch.setattr(leaks, "SLICE", piece)
    monkeypatch.setattr(leaks, "SENT", sent)
    monkeypatch.setattr(leaks, "MOST_BITS", bits)
    rng = random.Random(9)
    items = [(i, " ".join(f"w{rng.randrange(60)}" for _ in range(rng.randrange(3, 40)))) for i in range(30)] + [(90, None), (91, ""), (None, "a b c d e f")]
    docs = []
    for i in range(80):
        words = [f"w{rng.randrange(60)}" for _ in range(rng.randrange(0, 60))]
        if i % 2:
            part = (items[i % 30][1]).split()
            part = [w if rng.random() > 0.06 else "sub" for w in part][: rng.randrange(3, 45)]
            words = words[:10] + part + words[10:]
        docs.append((i, " ".join(words)))
    docs += [(200, None), (201, ""), (202, "filler " * 50_000 + items[0][1]), (None, items[0][1]), (3, docs[3][1])]
    want = set()
    for (d, t), (i, q) in itertools.product(docs, items):
        g = grams(q)
        if d is not None and i is not None and t and g and len(g & grams(t)) >= 0.5 * len(g):
            want.add((d, i))
    df = spark.createDataFrame(docs, "key long, t string").withColumn("item", F.lit("clash"))
    hits = leaks.leaked(df, "key", "t", spark.createDataFrame(items, "item_id long, q string"), "item_id", "q", 0.5)
    assert {(r.doc, r.item) for r in hits.where("shared >= 0.5").collect()} == want
    seeds = ((0, 1, 3, 4), (0, 2, 3, 4), (0, 1, 2, 4))
    picked = lambda t, m: {tuple(g[i] for i in m) for g in grams(t)}
    texts, asked = dict(docs), dict(items)
    for r in hits.collect():
        w = re.findall(r"[^\W_]+", asked[r["item"]].lower())
        places, done = set(), set()
        for i in range(len(w) - 4):
            g = tuple(w[i:i + 5])
            if g not in done and any(tuple(g[j] for j in m) in picked(texts[r.doc], m) for m in seeds):
                places |= set(range(i, i + 5))
            done.add(g)
        assert r.tolerant == pytest.approx(len(places) / len(w))


def test_leaks_tolerate_substitutions(spark):
    item = " ".join(f"w{i}" for i in range(40))
    text = " ".join("SUB" if i % 8 == 4 else f"w{i}" for i in range(40))
    row = leaks.leaked(spark.createDataFrame([(1, text)], "k long, t string"), "k", "t", spark.createDataFrame([("a", item)], "i string, q string"), "i", "q", 0.3).first()
    assert row.tolerant > 0.9 and row.shared < 0.5


def test_leaks_of_nothing(spark):
    docs = spark.createDataFrame([(1, "a b c d e f")], "k long, t string")
    assert leaks.leaked(docs, "k", "t", spark.createDataFrame([], "i long, q string"), "i", "q").count() == 0


# ---- encodings

TEXTS = ["Voilà une série très précédente : l’équipe n’a gardé que la façade…", "Größe und Übertragung für die Maßnahme", "La réplica está pública, ¿quién envió la señal?", "A configuração não está disponível até à próxima reunião", "Każda łatwa część żyje w głębokość", "Příští měření ověří úložiště", "Önce görüşme ayırdı, değişiklik büyük şablon", "Проект связывает группа и узел, пока ответ ещё новая", "Το νέα έρευνα κρατά κάθε λίστα", "the team’s “offset” – a naïve coöperative"]


@pytest.mark.parametrize("text", TEXTS)
@pytest.mark.parametrize("wrong", ["cp1252", "cp1250", "cp1251", "cp437", "cp850", "mac_roman"])
def test_misread_utf8_is_restored(text, wrong):
    try:
        garbled = text.encode("utf-8").decode(wrong)
    except UnicodeDecodeError:
        garbled = "".join(bytes([b]).decode(wrong, "ignore") or chr(b) for b in text.encode("utf-8"))
    assert garbled != text
    fixed, why = mojibake.restore(garbled)
    assert why and fixed == text


@pytest.mark.parametrize("text", TEXTS[:9])
def test_twice_misread(text):
    twice = text
    for _ in range(2):
        twice = "".join(bytes([b]).decode("cp1252", "ignore") or chr(b) for b in twice.encode("utf-8"))
    fixed, why = mojibake.restore(twice)
    assert why and fixed == text


@pytest.mark.parametrize(("text", "right", "wrong"), [(TEXTS[4], "cp1250", "cp1252"), (TEXTS[5], "cp1250", "cp1252"), (TEXTS[6], "cp1254", "cp1252"), (TEXTS[7], "cp1251", "cp1252"), (TEXTS[7], "koi8_r", "cp1251"), (TEXTS[8], "cp1253", "cp1252"), (TEXTS[1], "cp1252", "cp850"), (TEXTS[1], "cp1252", "mac_roman")])
def test_single_byte(text, right, wrong):
    fixed, why = mojibake.restore(text.encode(right).decode(wrong))
    assert why == ["single byte"] and fixed == text


@pytest.mark.parametrize("text", [*TEXTS, "├── notes\n│   └── inbox.md", "A AÇÃO SÃO NÃO ALTERAR", "½ cup, 5 °C ± 2 µm, x² ≤ 3, 7 × 8, № 5, § 3", "В доме Сёмга", "naïve façade, señor", "", "plain", "emoji 🎉 and ✓"])
def test_rightly_unusual(text):
    assert mojibake.restore(text) == (text, [])


def test_only_places(spark):
    good = "Die Größe der Straße"
    text = good + "\n" + "für".encode().decode("cp1252") + " alle\n" + good
    assert mojibake.restore(text)[0] == good + "\nfür alle\n" + good
    rows = [(1, text), (2, good), (3, None), (4, ""), (5, "lost �"), (6, "ascii"), (1, text), (7, "é" * 50_000)]
    df = spark.createDataFrame(rows, "key long, restored string")
    got = mojibake.garbled(df, "key", "restored").collect()
    assert sorted((r.key, r.wrong) for r in got) == [(1, ["utf8 as cp1252"]), (1, ["utf8 as cp1252"]), (5, ["lost"])]
    assert mojibake.restored(df, "key", "restored").count() == len(rows)


@given(st.text(max_size=200))
@settings(max_examples=150, deadline=None)
def test_restore_never_fails(text):
    mojibake.restore(text)


# ---- encodings over many languages

SENTENCES = {
    'hu': 'Az árvíztűrő tükörfúrógép győri műhelyében készült, és öt évig működött.',
    'ro': 'Așa și-a amintit că țările vecine au fost în fața unei încercări grele.',
    'ro2': 'Aşa şi-a amintit că ţările vecine au fost în faţa unei încercări grele.',
    'is': 'Það er mjög gott að vera hér þegar sólin skín á fjöllin í byrjun október.',
    'pl': 'Zażółć gęślą jaźń, a potem źdźbło i łąka.',
    'cs': 'Příliš žluťoučký kůň úpěl ďábelské ódy.',
    'sk': 'Kŕdeľ šťastných ďatľov učí pri ústí Váhu mĺkveho koňa.',
    'sv': 'Flygande bäckasiner söka hwila på mjuka tuvor, säger någon från Malmö.',
    'da': 'Høj bly gom vandt fræk sexquiz på wc, åh nej.',
    'nb': 'Vår sære Zulu fra badeøya spilte jo whist.',
    'fi': 'Törkylempijävongahdus ja hyvää yötä äiti.',
    'et': 'Põdur Zagrebi tšellomängija-följetonist Ciqo külmetas kehvas garaažis.',
    'lv': 'Glāžšķūņa rūķīši dzērumā čiepj Baha koncertflīģeļu vākus.',
    'lt': 'Įlinkdama fechtuotojo špaga sublykčiojusi pragręžė apvalų arbūzą.',
    'sl': 'Hišničin bratec vzgaja polže pod fikusom, čeprav žuga.',
    'hr': 'Gojazni đačić s biciklom drži hmelj i finu vatu u džepu nošnje, čuješ li.',
    'sq': 'Unë mund të ha qelq dhe nuk më gjen gjë, çfarë është kjo.',
    'tr': "Pijamalı hasta yağız şoföre çabucak güvendi; İstanbul'da ığdır.",
    'az': 'Zəfər, jaketini də papağını da götür, bu axşam hava çox soyuq olacaq.',
    'ca': "Jove xef, porti whisky amb quinze glaçons d'hidrogen, coi! La col·lecció és aquí.",
    'gl': 'Viaxeiros no camiño, señor, están alí por última vez.',
    'es': 'El pingüino Wenceslao hizo kilómetros bajo exhaustiva lluvia; ¿qué señor? ¡Ñandú!',
    'pt': 'Luís argüia à Júlia que «brações, fé, chá, óxido, pôr, zângão» eram palavras.',
    'fr': "Voix ambiguë d’un cœur qui, au zéphyr, préfère les jattes de kiwis. « Déjà vu… » dit-il : l'été…”",
    'de': 'Zwölf Boxkämpfer jagen Viktor quer über den großen Sylter Deich – „Ä“ und „Ö“. ',
    'it': "Perché la città è così, più giù c'è un caffè.",
    'nl': "Pa's wijze lynx bezag vroom het fikse aquaduct, coöperatie en reünie.",
    'cy': 'Parciais fy jac codi baw hud llawn dŵr ger tŷ Mabon, ŵyr.',
    'ga': 'Chuaigh bé mhórsách le dlúthspád fíorfhinn trí hata mo dhea-phorcáin bhig in hÉireann.',
    'mt': 'Il-ħobż taż-żiju ġie mġarrab minn ċkejken.',
    'eo': 'Eĥoŝanĝo ĉiuĵaŭde kaj aĝo.',
    'vi': 'Tiếng Việt rất đẹp, những người bạn của tôi ở Hà Nội đều nói vậy.',
    'ru': 'Съешь ещё этих мягких французских булок, да выпей чаю.',
    'uk': "Щастям б'єш жук їх глицю в фон й ґедзь пріч. ВІДІЛІТЬ ТІЛІ. Її він.",
    'be': "У рудога вераб'я ў сховішчы ляжаць арэхі.",
    'bg': 'Жълтата дюля беше щастлива, че пухът цъфна и ѝ каза.',
    'sr': 'Љубазни фењерџија чађавог лица хоће да ми покаже штос.',
    'mk': 'Ѕидарски пејзаж: шугав билмез со чудење џвака ќофте и кељ на туѓ цех.',
    'kk': 'Қазақстан — біздің Отанымыз, әр адам үшін өте ғажап жер.',
    'el': 'Ξεσκεπάζω την ψυχοφθόρα βδελυγμία, ΐ και ΰ.',
    'ar': 'نص حكيم له سر قاطع وذو شأن عظيم مكتوب على ثوب أخضر',
    'he': 'דג סקרן שט בים מאוכזב ולפתע מצא חברה',
    'fa': 'همه\u200cی افراد بشر آزاد به دنیا می\u200cآیند',
    'hi': 'ऋषियों को सताने वाले दुष्ट राक्षसों के राजा',
    'th': 'เป็นมนุษย์สุดประเสริฐเลิศคุณค่า',
    'ja': 'いろはにほへと ちりぬるを、東京の天気は良いです。',
    'zh': '天地玄黄，宇宙洪荒。日月盈昃，辰宿列张。',
    'zht': '視野無限廣，窗外有藍天。',
    'ko': '키스의 고유조건은 입술끼리 만나야 하고 특별한 기술은 필요치 않다.',
    'ka': 'ბაყაყმა ქვევრში წყალი ნახა',
    'hy': 'Բել դղյակի ձախ ժամն օֆ',
    'am': 'ሰው እንደ ቤቱ እንጅ እንደ ጉረቤቱ አይተዳደርም',
    'en': 'The naïve café in Zürich was run by Mr. Łukasz Žižek and Þór of Malmö.',
    'mix': 'Der Präsident Václav Havel traf Lech Wałęsa in Besançon und Győr.',
    'caps': 'CAFÉ… MÊME ÖSTERREICH „ÄÖÜ“ ŻÓŁĆ ČEŠTINA ÚŽASNÉ ÍŠ À LA',
    'sv2': '- Å…\n- Ö”\n- É»',
    'yo': 'Ọjọ́ tí ó dára ni ọ̀rẹ́ mi',
    'mi': 'Tēnā koutou, he aha te mea nui o te ao?',
    'sw': 'Habari yako – nzuri sana',
    'id': 'Apa kabar? “Baik”…',
    'no2': '° 20 °C ± 3 µm × 2 ² ½',
}


def misread(text: str, encoding: str) -> str:
    """``text`` in UTF-8 read as a legacy encoding; bytes that it does not define become control characters."""
    return "".join(bytes([b]).decode(encoding, "ignore") or chr(b) for b in text.encode("utf-8"))


@pytest.mark.parametrize("name", SENTENCES)
def test_right_text_stays(name):
    assert mojibake.restore(SENTENCES[name]) == (SENTENCES[name], [])


@pytest.mark.parametrize("encoding", ["latin-1", "cp1252", "cp1250", "cp1251", "cp437", "cp850", "mac_roman", "koi8_r"])
@pytest.mark.parametrize("name", [k for k in SENTENCES if k not in ("en", "mix", "caps", "sv2", "no2", "id", "sw")])
def test_misread_sentences(name, encoding):
    fixed, why = mojibake.restore(misread(SENTENCES[name], encoding))
    assert why and fixed == SENTENCES[name]


@pytest.mark.parametrize("rounds", [2, 3, 6, 9])
@pytest.mark.parametrize("name", ["hu", "ru", "fr", "ja", "vi", "ar"])
def test_any_number_of_rounds(name, rounds):
    text = SENTENCES[name]
    for _ in range(rounds):
        text = misread(text, "cp1252")
    assert mojibake.restore(text)[0] == SENTENCES[name]


@pytest.mark.parametrize(("name", "encoding"), [("ja", "cp932"), ("ja", "euc_jp"), ("zh", "gbk"), ("zht", "big5"), ("ko", "euc_kr")])
@pytest.mark.parametrize("wrong", ["latin-1", "cp1252"])
def test_double_byte_read_as_western(name, encoding, wrong):
    text = "".join(bytes([b]).decode(wrong, "ignore") or chr(b) for b in SENTENCES[name].encode(encoding))
    assert mojibake.restore("plain line\n" + text)[0] == "plain line\n" + SENTENCES[name]


def test_utf8_read_as_double_byte():
    assert mojibake.restore(SENTENCES["ru"].encode().decode("gbk"))[0] == SENTENCES["ru"]


@pytest.mark.parametrize(("name", "right", "wrong"), [("hu", "cp1250", "cp1252"), ("ro2", "cp1250", "cp1252"), ("pl", "cp1250", "cp1252"), ("ru", "cp1251", "cp1252"), ("ru", "koi8_r", "cp1251"), ("ru", "cp866", "cp1251"), ("el", "cp1253", "cp1252"),
    ("ar", "cp1256", "cp1252"), ("tr", "cp1254", "cp1252"), ("lt", "cp1257", "cp1252"), ("lv", "cp1257", "cp1252"), ("is", "cp1252", "mac_roman")])
def test_single_byte_languages(name, right, wrong):
    raw = SENTENCES[name].encode(right, "ignore")
    assert mojibake.restore(raw.decode(wrong))[0] == raw.decode(right)


def test_control_characters_are_reported():
    assert mojibake.restore("Strange w\x92rd 漢字 here")[1] in (["unrestored"], ["single byte"])


# ---- neighbours

def brute(keys, owners, x, k, least):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T
    out = {}
    for i in range(len(x)):
        order = sorted((j for j in range(len(x)) if owners[j] != owners[i] and s[i, j] >= least), key=lambda j: (-round(float(s[i, j]), 6), keys[j]))
        out[keys[i]] = [keys[j] for j in order[:k]]
    return out


def clustered(n, dims=16, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n // 12, dims))
    return (centres[rng.integers(0, len(centres), n)] + 0.25 * rng.normal(size=(n, dims))).astype(np.float32)


def test_neighbours_in_one_part_are_exact(spark):
    x = clustered(300)
    owners = [i // 2 for i in range(300)]
    df = spark.createDataFrame([(i, owners[i], x[i].tolist()) for i in range(300)], "key long, owner long, v array<float>").withColumn("part", F.lit("clash"))
    got = {}
    for r in neighbours.nearest(df, 3).orderBy("key", F.col("similarity").desc(), "near").collect():
        got.setdefault(r.key, []).append(r.near)
    want = brute(list(range(300)), owners, x, 3, -1)
    assert sum(len(set(got[i]) & set(want[i])) for i in want) >= 0.999 * 900


def test_recall_over_parts(spark):
    n = 3000
    x = clustered(n)
    df = spark.createDataFrame([(i, i, x[i].tolist()) for i in range(n)], "key long, owner long, v array<float>")
    got = {(r.key, r.near) for r in neighbours.nearest(df, 5, part_size=250).collect()}
    want = {(a, b) for a, bs in brute(list(range(n)), list(range(n)), x, 5, -1).items() for b in bs}
    assert len(got & want) >= 0.9 * len(want)


def test_recall_over_leaves(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "MAX_PARTS", 6)
    monkeypatch.setattr(neighbours, "SAMPLE_PER_PART", 100)
    n = 3000
    x = clustered(n)
    df = spark.createDataFrame([(i, i, x[i].tolist()) for i in range(n)], "key long, owner long, v array<float>")
    got = {(r.key, r.near) for r in neighbours.nearest(df, 5, part_size=150).collect()}
    want = {(a, b) for a, bs in brute(list(range(n)), list(range(n)), x, 5, -1).items() for b in bs}
    assert len(got & want) >= 0.9 * len(want)


def test_parts_are_balanced():
    x = clustered(2000)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = neighbours.balanced_parts(x, neighbours.neighbour_graph(x, 8), 10)
    assert np.bincount(label).max() <= 2000 / 10 * 1.15 + 1


def test_hot_vector_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 50)
    x = np.vstack([np.tile(np.ones(8, np.float32), (200, 1)), clustered(200, 8)])
    df = spark.createDataFrame([(i, i, x[i].tolist()) for i in range(400)], "key long, owner long, v array<float>")
    got = {}
    for r in neighbours.nearest(df, 3, 0.999, part_size=100).collect():
        got.setdefault(r.key, set()).add(r.near)
    assert all(got[i] == {j for j in range(4) if j != i} or got[i] == {0, 1, 2} for i in range(200))


def test_unusable_vectors(spark):
    rows = [(1, "a", [1.0, 0.0], [[1.0, 1.0], None, [0.0, 0.0]]), (2, "b", [1.0, 0.1], None), (3, None, None, [[1.0, float("nan")], [1.0]]), (4, "a", [float("inf"), 1.0], []), (None, "x", [1.0, 0.0], [])]
    df = spark.createDataFrame(rows, "entry_id long, id string, embedding array<float>, chunk_embeddings array<array<float>>")
    v = neighbours.entry_vectors(df, 2)
    assert sorted(r.key for r in v.collect()) == [100, 101, 200]
    assert sorted((r.key, r.near) for r in neighbours.nearest(v, 5, 0.5).collect()) == [(100, 200), (101, 200), (200, 100), (200, 101)]
    assert neighbours.nearest(v.limit(0), 5).count() == 0
