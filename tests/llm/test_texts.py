"""Near-duplicates, cross-split overlap, leakage and wrong decodings against brute force and edge cases."""

import random
from collections import Counter

import numpy as np
import pytest

from quillgraph.llm import leakage, mojibake, neardup, overlap

WORDS = [f"w{i}" for i in range(60)] + ["the", "of", "and"]


def slow_pairs(texts):
    bags = {i: Counter(neardup.words(t)) for i, t in texts if t and neardup.words(t)}
    out = set()
    for i in bags:
        for j in bags:
            if i < j and sum((bags[i] & bags[j]).values()) >= 0.75 * max(sum(bags[i].values()), sum(bags[j].values())):
                out.add((i, j))
    return out


def random_texts(seed, n=120):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        if i and rng.random() < 0.5:
            ws = (out[rng.randrange(len(out))] or "").split()
            for _ in range(rng.randrange(4)):
                if ws:
                    ws[rng.randrange(len(ws))] = rng.choice(WORDS)
            rng.shuffle(ws)
        else:
            ws = [rng.choice(WORDS) for _ in range(rng.choice([1, 2, 3, 5, 8, 20]))]
        out.append(rng.choice([" ".join(ws), " ".join(ws).upper() + "!", ", ".join(ws)]))
    return out + [None, "", "--", "  "]


@pytest.mark.parametrize("seed, hot", [(0, neardup.HOT), (1, 2)])
def test_near_duplicates(spark, monkeypatch, seed, hot):
    monkeypatch.setattr(neardup.near_duplicates, "__defaults__", ("row_id", hot))
    texts = list(enumerate(random_texts(seed)))
    df = spark.createDataFrame([(i, t, None, "clash", 1) for i, t in texts], "row_id long, a string, b string, items string, k int")
    got = {tuple(r) for r in neardup.duplicate_pairs(df, ["a", "b"]).collect()}
    assert got == slow_pairs(texts)
    groups = {r.row_id: r.group_row_id for r in neardup.duplicate_groups(df, ["a"]).collect()}
    assert all(groups[i] == groups[j] for i, j in got) and set(groups) == {x for p in got for x in p}


def test_no_questions(spark):
    df = spark.createDataFrame([], "row_id long, a string")
    assert neardup.duplicate_pairs(df, ["a"]).count() == 0


QA = "row_id long, split string, question string, gold_plan string, x string, a long"
PLAN = '{"constraints": [{"field": "y", "op": "eq", "value": 2020}, {"field": "n", "op": "eq", "value": "Ab  C"}], "answer_operation": "count", "answer_field": "id"}'
LAID_OUT = '{ "answer_field":"id",\n "answer_operation":"count", "constraints":[{"op":"eq","value":"ab c","field":"n"},{"value":"2020","field":"y","op":"eq"}], "note": 1}'


def test_groups_of_one_template_need_few_links(spark):
    base = [f"t{i}" for i in range(16)]
    rows = [(i, " ".join([*base, f"own{i}", f"more{i}"])) for i in range(300)] + [(1000 + i, t) for i, t in enumerate(random_texts(9))]
    df = spark.createDataFrame(rows, "row_id long, text string")
    members, links = neardup.group_links(df, "text", hot=5)
    links = links.distinct().count()
    _, every = neardup.near_duplicates(df, "text", hot=5)
    assert links < 2000 < 300 * 299 // 2 <= every.count()
    got = {r.row_id: r.group_row_id for r in neardup.duplicate_groups(df, ["text"]).collect()}
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in slow_pairs(rows):
        x, y = sorted((find(a), find(b)))
        root[y] = x
    assert got == {x: find(x) for x in root}


def _asked(n):
    """Requests of several templates with their plans; every plan in a plain wording and in one with a word that asks nothing."""
    out = []
    for i in range(n):
        name, year = f"Corp{chr(97 + i % 26)}{chr(97 + i // 26)}xq Holdings", 2010 + i % 9
        what = ("Which suppliers appear on contracts that went to", "How many records were awarded in all to")[i % 2]
        plan = PLAN.replace("2020", str(year)).replace("Ab  C", name)
        q = f"{what} {name} and fall in the year {year}?"
        out += [("train", q, plan), (None, q, plan), (None, q.replace("appear", "actually appear") if i % 2 == 0 else "Quick question: " + q, plan), (None, q.replace(" that ", " which ") + " Many thanks.", plan)]
    return out


def test_overlaps(spark):
    q = "Which suppliers appear on contracts that went to Alpha Beta Ltd and fall in the year 2022?"
    rows = [
        (1, "train", q, None), (2, "dev", "which suppliers appear on contracts WHICH went to alpha beta ltd & fall in the year 2022", None), (3, "ood", "Quick question: " + q + " Many thanks.", None),
        (4, "final_test", q.replace("2022", "2023"), None), (5, "dev", q.replace("Beta", "Gamma"), None), (6, None, q, None), (7, "train", "x", PLAN), (8, "dev", "y", LAID_OUT), (9, "dev", "z", LAID_OUT[:60]),
        (10, "ood", "", PLAN.replace("count", "sum")), (11, " Train ", q, PLAN), (12, "dev", None, "{}"), (13, "train", None, "{}"), (14, "dev", "  ", " "),
        (15, "dev", q.replace("contracts", "contrcats"), None), (16, "dev", q.replace("Beta", "Betta"), None), (17, "dev", "Which suppliers appear on contracts that fall in the year 2022 and went to Alpha Beta Ltd?", None),
        (18, "dev", q.replace("suppliers", "records"), None), *((20 + i, None, q.replace("Which", w), PLAN.replace("Ab  C", "Alpha Beta Ltd")) for i, w in enumerate(["What", "All", "List"])),
    ]
    more = [(100 + i, *r) for i, r in enumerate(_asked(60))]
    df = spark.createDataFrame([(*r, "clash", 1) for r in [*rows, *more]], QA)
    got = {(r.row_id_a, r.row_id_b, r.by) for r in overlap.overlaps(df).where("row_id_a < 100").collect()}
    same = {(1, i, "question") for i in (2, 3, 15, 17)} | {(min(i, 11), max(i, 11), "question") for i in (2, 3, 15, 17)}
    assert got == same | {(7, 8, "gold_plan"), (8, 11, "gold_plan")}
    assert overlap.overlaps(df.limit(0)).count() == 0


def test_what_differs_and_winnowing():
    template = frozenset(["supplier", "contracts", "were", "list", "buyer", "firm", "which"])
    assert overlap.unmatched("the contrcats of 2020 were alpha".split(), "the contracts of 2021 where alpha".split(), template) == (["2020"], ["2021"], {"contrcats": "contracts", "were": "where"})
    assert overlap.unmatched(["alpha"], ["alphas"], template)[:2] == (["alpha"], ["alphas"])
    none = frozenset()
    assert overlap.same_order("that were given and were sold".split(), "that where given and were sold".split(), template, none, {"were": "where"})
    assert not overlap.same_order("buyer alpha firm beta".split(), "buyer beta firm alpha".split(), template, none, {})
    assert overlap.same_order("buyer alpha firm beta which".split(), "firm beta which buyer alpha".split(), template, none, {})
    text = "the quick brown fox jumps over the lazy dog again and again"
    shared = overlap.winnow("prefix " + text).keys() & overlap.winnow(text + " suffix").keys()
    assert shared and overlap.winnow("") == {} and len(overlap.winnow("short")) == 1
    assert overlap.coverage(text, text) == 1 and overlap.coverage(text, "prefix " + text + " suffix") == 1 and overlap.coverage(text, "nothing of that kind") == 0


@pytest.mark.parametrize("seed", range(4))
def test_the_index_finds_every_occurrence(seed):
    rng = np.random.default_rng(seed)
    sigma = 7
    text = rng.integers(0, sigma, 400) if seed else np.tile([1, 2, 1, 2, 1, 0], 60)
    fm = leakage.FMIndex(text, sigma, step=5)
    phrases = rng.integers(1, sigma, (200, 3))
    lo, hi = fm.search(phrases)
    for p, a, b in zip(phrases, lo, hi):
        want = [i for i in range(len(text) - 2) if (text[i : i + 3] == p).all()]
        assert sorted(fm.locate(np.arange(a, b)).tolist() if b > a else []) == want


ITEM = " ".join(f"item{i}" for i in range(40))
COMMON = "all values exclude tax unless a schedule states another rule"


def passage(n, change=()):
    ws = [w if i not in change else "other" for i, w in enumerate(ITEM.split()[5 : 5 + n])]
    return " ".join(ws)


def test_leaks(spark):
    docs = {
        1: f"Before. {passage(25).upper()}. After", 2: f"x {passage(12)} y", 3: f"x {passage(24, {6, 15})} y", 4: f"x {passage(24, set(range(0, 24, 4)))} y", 5: None, 6: "", 7: COMMON, 8: passage(30).replace(" ", ",\n "),
        9: " ".join(f"filler{i}" for i in range(60_000)) + " " + passage(22), 10: f"{passage(22)} gap {passage(22)}", 11: f"{passage(25)}",
    }
    more = [(100 + i, f"{COMMON} filler{i}") for i in range(80)]
    items = [(1, ITEM + " " + COMMON), (2, COMMON), (3, None), (4, "too short")]
    d = spark.createDataFrame([*docs.items(), *more], "doc_id long, text string")
    e = spark.createDataFrame(items, "item_id long, text string")
    found = leakage.leaks(d, e)
    assert {(r.doc_id, r.item_id) for r in found.collect()} == {(i, 1) for i in (1, 3, 8, 9, 10, 11)}
    spans = {r.doc_id: (r.first_word, r.end_word) for r in leakage.removal_spans(found).collect()}
    assert spans[1] == (1, 26) and spans[9] == (60_000, 60_022)
    assert leakage.leaks(d.limit(0), e).count() == 0 and leakage.leaks(d, e.limit(0)).count() == 0


def test_a_passage_counts_with_its_common_sentence(spark):
    own = " ".join(f"u{i}" for i in range(14))
    item = f"{own} {COMMON} tail words of the item that no document repeats here or there"
    docs = [(1, f"a {own} {COMMON} b")] + [(10 + i, COMMON) for i in range(80)]
    found = leakage.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(5, item)], "item_id long, text string"))
    assert [(r.doc_id, r.item_id) for r in found.collect()] == [(1, 5)]


def test_copies_and_repetitions_make_no_phrase_common(spark):
    copies = [(i, f"a {passage(25)} b") for i in range(80)]
    docs = [*copies, (100, f"c {passage(25)} d"), (101, " and ".join([passage(25)] * 60))] + [(200 + i, f"{COMMON} filler{i}") for i in range(80)]
    found = leakage.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, ITEM)], "item_id long, text string"))
    assert sorted({(r.doc_id, r.item_id) for r in found.collect()}) == [(i, 1) for i in [*range(80), 100, 101]]


def test_the_most_copied_item_is_found_everywhere(spark):
    short = " ".join(f"rare{i}" for i in range(24))
    docs = [(i, f"own{i} {short} end{i}" if i < 120 else f"own{i} text{i} {COMMON} end{i}") for i in range(4000)]
    items = [(1, short), (2, f"{COMMON} {ITEM}"), (3, COMMON + " " + COMMON.replace("values", "amounts")), (None, short), (4, None)]
    d, e = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in leakage.leaks(d, e).collect()) == [(i, 1) for i in range(120)]
    assert sorted((r.doc_id, r.item_id) for r in leakage.leaks(d, e, block=100).collect()) == [(i, 1) for i in range(120)]


def test_a_passage_may_lose_its_common_sentence(spark):
    a, b = " ".join(f"u{i}" for i in range(14)), " ".join(f"v{i}" for i in range(14))
    docs = [(1, f"x {a} {b} y"), (2, f"x {a} {COMMON} {b} y"), (3, f"x {a} y")] + [(10 + i, f"{COMMON} z{i}") for i in range(80)]
    found = leakage.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(5, f"{a} {COMMON} {b}")], "item_id long, text string"))
    assert sorted((r.doc_id, r.first_word, r.end_word) for r in found.collect()) == [(1, 1, 29), (2, 1, 39)]


def test_every_stretch_of_an_item_leaks(spark):
    long = [f"item{i}" for i in range(100)]
    gap = long[:20] + ["other"] * 8 + long[28:48]
    docs = [(1, " ".join(["x", *gap, "y"])), (2, " ".join([*long[:25], *["gap"] * 30, *long[60:90]])), (3, " ".join([*long[:22], "gap", *long[:22]])), (4, " gap ".join([" ".join(long[:30])] * 40)), (5, " ".join([*long[:9], *["other"] * 4, *long[13:24]]))]
    found = leakage.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, " ".join(long))], "item_id long, text string"))
    got = {}
    for r in found.collect():
        got.setdefault(r.doc_id, []).append((r.first_word, r.end_word))
    got = {i: sorted(x) for i, x in got.items()}
    assert got == {1: [(1, 21), (29, 49)], 2: [(0, 25), (55, 85)], 3: [(0, 22), (23, 45)], 4: [(31 * k, 31 * k + 30) for k in range(40)]}


CLEAN = {
    "en": ["The buyer’s reference for lot {i} is “standstill” – a price of £{i},250 at 4 °C near the café, a naïve plan.", "Termination needs {i} days’ notice in writing; the fee is £{i}."],
    "fr": ["Les offres doivent être déposées à la mairie avant le {i} mai, délai de rigueur.", "Le marché {i} a été attribué après négociation, à £{i},000 hors taxes."],
    "de": ["Angebote müssen bis {i} Uhr eingehen; verspätete Angebote werden nicht berücksichtigt. Straße {i}.", "Der Zuschlag für {i} ging an die GRÖSSERE Firma."],
    "bg": ["Поръчка {i} е възложена на фирмата. Критерии: качество {i}%, цена.", "Офертите се подават до {i} часа."], "pt": ["A adjudicação {i} foi feita após avaliação técnica. CONTRATAÇÃO PÚBLICA {i}."], "cy": ["Rhaid i gynigion gyrraedd erbyn {i}; dŵr, tŷ a chaffael. TÂN AC ACHUB {i}."],
}


def wrong(text, *steps):
    for a, b in steps:
        text = text.encode(a).decode(b)
    return text


def test_wrong_decodings_are_found_and_undone(spark):
    rows = [(f"{lang}", t.format(i=i)) for lang, ts in CLEAN.items() for t in ts for i in range(40)]
    good = "The fee is £5,250 – see the café’s “standstill” plan near the buyer."
    cases = {
        1: wrong(good, ("utf-8", "cp1251")), 2: wrong(good, ("utf-8", "mac_roman")), 3: wrong(good, ("utf-8", "latin-1")), 4: wrong(good, ("utf-8", "latin-1"), ("utf-8", "latin-1")), 5: wrong(good, ("utf-8", "cp437")),
        6: wrong(good, ("utf-8", "cp850")), 7: wrong(good, ("cp1252", "cp1251")), 8: wrong(good, ("cp1252", "mac_roman")), 9: "First part is fine. " + wrong(good, ("utf-8", "cp1251")),
    }
    lost = {20: "The fee is ��5,250 today.", 21: "Le march� de la ville."}
    clean = {30: good, 31: None, 32: "", 33: " \n", 34: "MARCHÉ À TRANCHES – GRÂCE À Lille", 35: "番号の入札公告 👍🏽 ½ №", 36: "plain", 37: CLEAN["bg"][0].format(i=7), 38: "TÂN AC ACHUB; CONTRATAÇÃO PÚBLICA", 39: "x" * 100_000}
    docs = [(1000 + i, t, lang) for i, (lang, t) in enumerate(rows)] + [(i, t, "en") for d in (cases, lost, clean) for i, t in d.items()]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    got = {r.doc_id: (r.text, r.garbled) for r in mojibake.repair_corpus(df).where("doc_id < 1000").collect()}
    for i in cases:
        assert got[i][1], i
        assert got[i][0] == (good if i != 9 else "First part is fine. " + good), i
    assert all(got[i][1] for i in lost)
    assert {i: got[i] for i in clean} == {i: (t, False) for i, t in clean.items()}
    assert not any(r.garbled for r in mojibake.repair_corpus(df).where("doc_id >= 1000").collect())
    assert mojibake.repair_corpus(df.limit(0)).count() == 0


def test_a_letter_the_sample_lacks_is_restored(spark):
    docs = [(1000 + i, t.format(i=i), lang) for lang, ts in CLEAN.items() for t in ts for i in range(40)]
    good = {1: "The fee is £5,250 for the office in Köln near the café.", 2: "Mr Szabó and Mr Novák signed the plan – it costs £{i},000.", 3: "Bids go to Malmö… at a price of £5,250."}
    cases = {10 * i + k: (t, wrong(t, ("utf-8", codec))) for i, t in good.items() for k, codec in enumerate(["cp1251", "mac_roman", "latin-1", "cp437"])}
    df = spark.createDataFrame([*docs, *((i, t, "en") for i, (_, t) in cases.items()), *((i, t, "en") for i, t in good.items())], "doc_id long, text string, lang string")
    got = {r.doc_id: (r.text, r.garbled) for r in mojibake.repair_corpus(df).where("doc_id < 1000").collect()}
    assert got == {i: (t, True) for i, (t, _) in cases.items()} | {i: (t, False) for i, t in good.items()}


def test_the_model_is_counted_over_all_documents(spark):
    """A piece, a word and a letter that only late documents of a language have count with all others."""
    docs = [(i, f"The price of lot {i} is £{i},250 and it is paid within thirty days of the invoice.", "en") for i in range(3000)]
    docs += [(3000 + i, f"The office in Köln has asked bidders for a quotation of lot {i} by next month.", "en") for i in range(60)]
    dictionaries, usual, frequent = mojibake.train(spark.createDataFrame(docs, "doc_id long, text string, lang string"))
    assert len(dictionaries) == 1 and "in Köln has" in dictionaries[0].decode() and "ö" in usual and {"quotation", "invoice"} <= frequent
    count = [c for b in mojibake._counted(iter([])) for c in b.to_pylist()]
    assert count == [] and list(mojibake.pieces("At 12 £5 a day. Plain here. Café")) == ["00 £0 a", " Café"]


FOREIGN = [
    "Zadavatel zajistí údržbu zařízení a služby v přístavu do 5 let, cena £5,000 bez daně.", "Autoritatea contractantă achiziționează servicii de curățenie și întreținere pentru școli.",
    "Zamawiający udzieli zamówienia na usługi sprzątania; część płatności nastąpi później.", "Az ajánlatkérő épület-karbantartási szolgáltatást rendel, a díj fizetése később történik, űrlap mellékelve.",
    "İdare, bakım hizmetleri için teklif çağrısı yapmıştır; ödeme süresi değişebilir.", "Upphandlingen avser städtjänster för skolor på Öland, anbud lämnas före lördag.",
    "El órgano de contratación adjudicó el año pasado la señalización, ¿cuándo se pagó? Más información aquí.", "Naručitelj će sklopiti ugovor o održavanju, što uključuje čišćenje i žbukanje.",
    "Её заказчик объявил закупку услуг по уборке помещений. Ёлка и подъезд включены.", "Від замовника: Її послуги надаються відповідно до договору; Ґрунт і під’їзд.",
    "Η αναθέτουσα αρχή προμηθεύεται υπηρεσίες καθαρισμού. Άρθρο 5 όπως ισχύει.", "La città è già più pulita perché l’università pagò però il servizio.",
    "Kaupandi óskar eftir þjónustu við þrif á skólum, ræsting og viðhald í ágúst.", "采购人购买清洁服务。", "Perkančioji organizacija įsigyja valymo paslaugų, kurių vertė žymiai didesnė šįmet.",
]


def test_correct_text_of_languages_without_a_dictionary_is_left_alone(spark):
    docs = [(1000 + i, t.format(i=i), lang) for lang, ts in CLEAN.items() for t in ts for i in range(40)]
    df = spark.createDataFrame([*docs, *((i, t, None) for i, t in enumerate(FOREIGN))], "doc_id long, text string, lang string")
    got = {r.doc_id: (r.text, r.garbled) for r in mojibake.repair_corpus(df).where("doc_id < 1000").collect()}
    assert got == {i: (t, False) for i, t in enumerate(FOREIGN)}


def test_texts_that_share_enough_share_a_key():
    import random

    import numpy as np

    from quillgraph.llm import overlap as V

    rng = random.Random(5)
    texts = [sorted(rng.sample(range(60), rng.randint(1, 25))) for _ in range(150)]
    # Ten fingerprints that few texts have and eight that both have, but that are more frequent: none of the eight rarest is shared.
    texts += [[*range(100, 110), *range(200, 208)], [*range(110, 120), *range(200, 208)], list(range(100, 120)), list(range(100, 120))] + [list(range(200, 208))] * 3
    freq = np.zeros(V.SLOTS, dtype=np.int64)
    for t in texts:
        for p in t:
            freq[p] += 1
    for hot in (3, 20, 500):
        keys = [set(V.lookup_keys(t, freq, hot)) for t in texts]
        for i, a in enumerate(texts):
            for j, b in enumerate(texts[:i]):
                if len(set(a) & set(b)) >= V.SKETCH * max(len(a), len(b)):
                    assert keys[i] & keys[j], (a, b, hot)


def test_texts_made_one_request_ask_the_same():
    import random

    from quillgraph.llm import overlap as V

    rng = random.Random(7)
    template = frozenset("contracts contract award awarded have were what which suppliers records list code name please total value".split())
    neutral = frozenset("please actually records that which me thanks data".split())

    def edited(w: str) -> str:
        i = rng.randrange(len(w))
        return rng.choice([w[:i] + w[i + 1 :], w[:i] + "e" + w[i:], w[:i] + "a" + w[i + 1 :], w[: i - 1] + w[i : i + 1] + w[i - 1 : i] + w[i + 1 :] if i else w])

    words = sorted(template | neutral) + ["alpha", "betta", "2022", "a1", "of", "in"]
    words += [edited(w) for w in words if len(w) > 3 for _ in range(6)]
    ask, one = V.asking(template, neutral), 0
    for a in words:
        for b in words:
            left, right, _ = V.unmatched(["in", a], ["in", b], template)
            rest = {w for w in left + right if not (w in neutral or (w not in template and w.isalpha() and len(w) > 3 and any(len(n) > 3 and V._one_edit(w, n) for n in neutral)))}
            if a != b and not rest:
                one += 1
                assert ask(["in", a]) == ask([b, "in"]), (a, b)
    assert one > 100
    # The same template and year with other names, years or codes ask something else, so they are never compared.
    said = ["suppliers awarded to {} {} in {}".format(*x) for x in [("alpha", "betta", 2022), ("gamma", "betta", 2022), ("alpha", "gamma", 2022), ("alpha", "betta", 2023)]]
    assert len({ask(s.split()) for s in said}) == 4
