"""Leaks, mixing and personal information."""

import base64
import quopri
import random
from collections import Counter

import pytest

from hitloom.llm import leak, mailtext, mix, pii, pii_train

ITEM = "A mechanic splices 166 metres of woven gasket stock, then stacks the oiled lantern beside the tannery."
PASSAGE = "166 metres of woven gasket stock then stacks the oiled lantern beside"  # 12 words


def mail(body, kind="text/plain", encoding="", multipart=False, closed=True):
    head = f"Content-Type: {kind}; charset=utf-8\n" + (f"Content-Transfer-Encoding: {encoding}\n" if encoding else "")
    if not multipart:
        return f"From: a@b.example\n{head}\n{body}"
    return f'From: a@b.example\nContent-Type: multipart/mixed; boundary="=_x"\n\n--=_x\n{head}\n{body}\n' + ("--=_x--\n" if closed else "")


def b64(s):
    return base64.encodebytes(s.encode()).decode()


CASES = [
    (PASSAGE, True), (PASSAGE.upper(), True), (PASSAGE.rsplit(" ", 1)[0], False), (PASSAGE.replace(" ", ", "), True), (PASSAGE.replace("gasket", "rubber gasket"), False),
    ("> " + PASSAGE.replace(" woven", "\n> > woven").replace(" oiled", "\n>| oiled"), True), ("AB> " + PASSAGE.replace(" woven", "\nAB> woven"), True), (PASSAGE.replace(" woven", "\r\n| woven"), True),
    (mail(PASSAGE), True), (mail(b64("x " + PASSAGE), encoding="base64"), True), (mail(b64(PASSAGE)[:-3], encoding="base64", multipart=True, closed=False), False), (mail(b64(PASSAGE + " now and then"), encoding="base64", multipart=True, closed=False), True),
    (mail(quopri.encodestring((PASSAGE + " é" * 40).encode()).decode(), encoding="quoted-printable"), True), (mail(PASSAGE.replace("woven", "wov=\nen"), encoding="quoted-printable", multipart=True), True),
    (mail("<p>" + PASSAGE.replace("woven", "<b>woven</b>").replace(" oiled", "&nbsp;oiled").replace(" of ", "<br>\nof ") + "</p>", "text/html"), True), (mail(b64("<i>" + PASSAGE + "</i>"), "text/html", "base64", True), True),
    (mail(b64(PASSAGE), "application/octet-stream", "base64", True), False), ("Subject: =?utf-8?b?" + base64.b64encode(PASSAGE.encode()).decode() + "?=\n\nx", True), ("", False), (None, False), ("word " * 400_000 + PASSAGE, True),
]


def test_leaks(spark):
    docs = spark.createDataFrame([(i, t, 7) for i, (t, _) in enumerate(CASES)] + [(0, PASSAGE, 7)], "doc_id long, text string, item_id int")
    items = spark.createDataFrame([(1, ITEM), (2, "too short"), (3, None), (4, ITEM + " Again."), (5, "another item " * 20)], "item_id long, item_text string")
    got = Counter(tuple(r) for r in leak.leaked(docs, items).collect())
    assert got == {(i, item): 1 for i, (_, want) in enumerate(CASES) if want for item in (1, 4)}
    assert leak.leaked(docs, items.limit(0)).count() == 0 and leak.leaked(docs.limit(0), items).count() == 0


def test_items_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(leak, "BLOCK_CHARS", 150)
    docs = spark.createDataFrame([(1, PASSAGE)], "doc_id long, text string")
    items = spark.createDataFrame([(i, ITEM if i in (0, 4) else f"x{i} " * 15) for i in range(5)], "item_id int, item_text string")
    assert sorted(tuple(r) for r in leak.leaked(docs, items).collect()) == [(1, 0), (1, 4)]


def test_wu_manber_equals_windows():
    r = random.Random(8)
    words = list("abcdefg")
    items = [(i, " ".join(r.choice(words) for _ in range(r.randrange(1, 9)))) for i in range(60)]
    patterns = {}
    for i, t in items:
        w = t.split()
        for k in range(len(w) - 3):
            patterns.setdefault(tuple(w[k : k + 4]), set()).add(i)
    m = leak.WuManber(items, 4)
    for _ in range(500):
        text = [r.choice(words + ["x"]) for _ in range(r.randrange(0, 30))]
        want = {i for k in range(len(text) - 3) for i in patterns.get(tuple(text[k : k + 4]), ())}
        assert m.search(text) == want


def nested(depth, inner):
    for k in range(depth):
        inner = f'Content-Type: multipart/mixed; boundary="b{k}"\n\n--b{k}\n{inner}\n--b{k}--\n'
    return inner


def quoted(text, mark="> "):
    return "".join(mark + x + "\n" for x in text.splitlines())


ENCODED = "Content-Type: text/plain; charset=utf-8\nContent-Transfer-Encoding: base64\n\n" + b64("x " + PASSAGE)
SOFT = "Content-Type: text/plain\nContent-Transfer-Encoding: quoted-printable\n\n" + PASSAGE.replace("woven", "wov=\nen")


@pytest.mark.parametrize(
    "text",
    [
        "From MAILER Mon, 1 Sep 2031 05:50:29 (CET)\n" + mail(b64("x " + PASSAGE), encoding="base64"),
        "From x@y Mon\r\n" + mail(SOFT.partition("\n\n")[2], encoding="quoted-printable", multipart=True).replace("\n", "\r\n"),
        "From: a@b.example\nContent-Type: message/rfc822\n\n" + mail(b64("x " + PASSAGE), encoding="base64"),
        nested(1, "Content-Type: message/rfc822\n\n" + nested(2, ENCODED)),
        nested(9, ENCODED), nested(400, SOFT),
        "Hi,\n\n" + quoted("From: a@b.example\n" + ENCODED), "Hi,\n\n" + quoted(quoted(SOFT)), "Hi,\n\n" + quoted(ENCODED, "AB> "),
        "Subject: fwd\n\nsee below\n\n-----Original Message-----\nFrom: a@b.example\nDate: today\n" + SOFT,
        "Begin forwarded message:\n\nFrom: a@b.example\n" + nested(2, ENCODED),
        mail("see <b>" + PASSAGE.replace(" woven", "</b> <i>woven</i>")),
    ],
)
def test_packed_messages(text):
    assert leak.WuManber([(1, ITEM)], 12).search(mailtext.words(text)) == {1}


def test_leaks_of_the_mail_against_plain_views(spark, sf_dir):
    """Every message of the tables against a search for all windows in several plainly decoded views of it."""
    import html
    import re

    from hitloom.llm import queries

    marks, blocks = re.compile(r"^[ \t>|]*(?:[^\W\d_]{1,4}>[ \t>|]*)*", re.M), re.compile(r"(?:^[A-Za-z0-9+/]{20,}={0,2}[ \t]*$\n?)+(?:^[A-Za-z0-9+/]+={0,2}[ \t]*$)?", re.M)

    def views(text):
        bare = marks.sub("", text.replace("\r\n", "\n"))
        soft = re.sub(r"(?:=[0-9A-F]{2})+", lambda m: bytes.fromhex(m[0].replace("=", "")).decode("utf8", "replace"), re.sub(r"=[ \t]*\n", "", bare))
        for x in (bare, soft):
            yield from (x, marks.sub("", html.unescape(re.sub(r"<[^<>]*>", " ", x))))
        for m in blocks.finditer(bare):
            packed = re.sub(r"[^A-Za-z0-9+/]", "", m[0])
            packed = packed[: len(packed) // 4 * 4]
            yield from (marks.sub("", html.unescape(re.sub(r"<[^<>]*>", " ", x))) for x in [base64.b64decode(packed).decode("utf8", "replace")])

    patterns = {}
    for r in spark.read.parquet(f"{sf_dir}/eval_item.parquet").collect():
        w = mailtext._WORD.findall(r.item_text.lower())
        for k in range(len(w) - 11):
            patterns.setdefault(tuple(w[k : k + 12]), set()).add(r.item_id)
    want = set()
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect():
        for v in views(r.text or ""):
            w = mailtext._WORD.findall(v.lower())
            want |= {(r.doc_id, i) for k in range(len(w) - 11) for i in patterns.get(tuple(w[k : k + 12]), ())}
    assert {tuple(r) for r in queries.p8_found(spark, sf_dir).collect()} == want


def test_broken_encodings():
    assert "a" in mailtext.readable(mail("====", encoding="base64"))
    assert mailtext.words(mail("=ZZ =C3=28 ok", encoding="quoted-printable"))[-1] == "ok"
    assert mailtext.words("Subject: =?utf-8?b?!!!?=\n\nbody")[-1] == "body"
    assert mailtext.words(mail("x", kind="text/plain; charset=no-such"))[-1] == "x"


# Mixing
def filled(spark, sizes, targets, total=None):
    rows = [(s, w, k, sizes.get(s)) for s, (w, k) in targets.items()]
    df = mix.water_fill(spark.createDataFrame(rows, "src string, w double, k int, size long"), total)
    return {r.src: r.wanted for r in df.collect()}


def test_water_filling(spark):
    sizes, targets = {"a": 100, "b": 100, "c": 10}, {"a": (0.5, 1), "b": (0.3, 2), "c": (0.2, 3)}
    exact = filled(spark, sizes, targets)
    assert sum(exact.values()) == pytest.approx(150) and exact["c"] == pytest.approx(30) and exact["a"] == pytest.approx(75)
    more = filled(spark, sizes, targets, 200)
    assert more == {"a": pytest.approx(100), "b": pytest.approx(70), "c": pytest.approx(30)}  # c and then a are clamped, b takes the rest
    assert filled(spark, sizes, targets, 10_000) == {"a": 100, "b": 200, "c": 30}
    assert filled(spark, {}, targets) == {"a": 0, "b": 0, "c": 0}
    assert filled(spark, {"a": 10}, {"a": (0.5, 2), "b": (0.5, 2)})["a"] == 20  # a source without tokens leaves its share to the others
    assert filled(spark, {"a": 10, "b": 10}, {"a": (None, 2), "b": (0.5, None), "c": (-1.0, 2)}, 5) == {"a": 0, "b": 0, "c": 0}
    assert filled(spark, sizes, targets, 0) == {"a": 0, "b": 0, "c": 0}


def plainly_filled(sizes, targets, total):
    """Round by round, as a plain loop."""
    open_, out, left = {s for s, (w, k) in targets.items() if w > 0 and k * sizes.get(s, 0) > 0}, dict.fromkeys(targets, 0.0), total
    while open_ and left > 0:
        weight = sum(targets[s][0] for s in open_)
        over = [s for s in open_ if left * targets[s][0] / weight > targets[s][1] * sizes[s] * (1 + 1e-12)]
        for s in over or open_:
            out[s] = float(targets[s][1] * sizes[s]) if over else left * targets[s][0] / weight
        if not over:
            break
        left -= sum(out[s] for s in over)
        open_ -= set(over)
    return out


def test_water_filling_at_random(spark):
    r = random.Random(12)
    for _ in range(6):
        targets = {f"s{i}": (r.random(), r.randrange(0, 4)) for i in range(12)}
        sizes = {s: r.choice([0, 5, 50, 500]) for s in targets}
        total = r.randrange(1, 4000)
        assert filled(spark, sizes, targets, total) == {s: pytest.approx(n) for s, n in plainly_filled(sizes, targets, total).items()}


def test_mix_without_ids(spark):
    rows = [(None, "one two", "a"), (None, "one two", "a"), (None, "three four five", "a"), (1, "six", "a"), (None, None, "a"), (2, "seven", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    targets = spark.createDataFrame([("A ", 1.0, 1)], "source string, target_share double, max_repeat int")
    got = sorted((r.doc_id or 0, r.n_tokens) for r in mix.mix_sources(docs, targets, characters=True).collect())
    assert got == [(0, 7), (0, 15), (1, 3)]
    assert len(mix.mix_sources(docs, targets).collect()) == 3


def test_mix(spark):
    r = random.Random(9)
    rows = [(i, "word " * r.randrange(1, 40) if i % 50 else None, r.choice(["big", "Big ", "BIG", "big", "mid-size", "mid_size", "tiny", None, "", "other"]), 1) for i in range(3000)] + [(5, "word word", "tiny", 1)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_tokens int")
    targets = spark.createDataFrame([("big", 0.5, 2), ("mid_size", 0.3, 3), ("tiny", 0.2, 4)], "source string, target_share double, max_repeat int")
    out = mix.mix_sources(docs, targets).collect()
    sizes, used = Counter(), Counter()
    for x in out:
        used[x.source] += x.n_tokens * x.repeats
        sizes[x.source] = max(sizes[x.source], x.repeats)
        assert 1 <= x.repeats <= {"big": 2, "mid_size": 3, "tiny": 4}[x.source]
    total = sum(used.values())
    for s, w in (("big", 0.5), ("mid_size", 0.3), ("tiny", 0.2)):
        assert used[s] / total == pytest.approx(w, abs=0.005)
    assert sorted(out) == sorted(mix.mix_sources(docs, targets).collect())  # the seed fixes the choice
    assert sorted(out) != sorted(mix.mix_sources(docs, targets, seed=8, total=total * 0.9).collect())
    report = {x.source: x for x in mix.mix_report(mix.mix_sources(docs, targets), targets).collect()}
    assert report["big"].actual_share == pytest.approx(0.5, abs=0.005) and report["big"].n_tokens == used["big"]
    assert mix.mix_sources(docs.limit(0), targets).count() == 0 and mix.mix_sources(docs, targets.limit(0)).count() == 0


def test_mix_of_all_tokens_clamps(spark, sf_dir):
    from hitloom.llm import queries

    docs, targets = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "source_target"))
    rows = mix.count_tokens(docs.select("doc_id", mix.source_name(docs.source).alias("src"), "text").distinct())
    goal = {r.src: (r.target_share, r.max_repeat) for r in targets.select(mix.source_name(targets.source).alias("src"), "target_share", "max_repeat").collect()}
    tokens = _by_source(rows.where("n_tokens > 0").collect())
    sizes = {s: sum(tokens.get(s, {}).values()) for s in goal}
    longest = {s: max(tokens.get(s, {0: 0}).values()) for s in goal}
    used = Counter()
    for r in queries.p9_mix_all(spark, sf_dir).collect():
        used[r.source] += r.n_tokens * r.repeats
    want = plainly_filled(sizes, goal, sum(sizes.values()))
    clamped = [s for s in goal if sizes[s] and want[s] == sizes[s] * goal[s][1]]
    assert clamped and all(used[s] == want[s] for s in clamped)
    assert all(want[s] - longest[s] - 1 <= used[s] <= want[s] + 1e-6 for s in goal)


def _by_source(rows):
    """Tokens by source and id, each id once as the smallest source and number."""
    first, out = {}, {}
    for r in rows:
        first[r.doc_id] = min(first.get(r.doc_id, (r.src or "~", r.n_tokens)), (r.src or "~", r.n_tokens))
    for i, (s, n) in first.items():
        out.setdefault(s, {})[i] = n
    return out


def test_tokens(spark):
    import public_tokenizers

    assert public_tokenizers.PATTERN == mix.PIECES
    docs = spark.createDataFrame([(1, "Hello world, again."), (2, ""), (3, None)], "doc_id long, text string")
    assert {r.doc_id: r.n_tokens for r in mix.count_tokens(docs).collect()} == {1: 5, 2: 0, 3: 0}


# Personal information
GAZ = pii.Gazetteer(words={"lena": "g", "may": "g", "will": "g", "rose": "g", "grace": "g", "bo": "g", "ortega": "s", "stone": "s", "quens": "s", "o'mara": "s", "velden": "s"})
SPANS = [
    ("Dear Dr. Ortega,\n\nAsk Lena Ortega about it. Lena K. ORTEGA said so.", [("name", "Ortega"), ("name", "Lena Ortega"), ("name", "Lena K. ORTEGA")]),
    ("Will somebody mark lane 3 as late before May? Rose by 4 percent. Grace period ends.", []),
    ("Dear May,\n\nok\n\nBest,\nBo\n", [("name", "May"), ("name", "Bo")]),
    ("Ask Ortega, Lena first. L. O'Mara and Lena de la Quens agreed. The stone basement froze.", [("name", "Ortega, Lena"), ("name", "L. O'Mara"), ("name", "Lena de la Quens")]),
    ("From: \"Mac Velden, Bo\" <bo+x@lab.example>\nMessage-ID: <0a1b2c3d4e5.77@lab.example>\nReferences: <0a1b2c3d4e5.77@lab.example>\n <0a1b2c3d4e6.78@lab.example>\n\nhi", [("name", "Mac Velden, Bo"), ("email", "bo+x@lab.example")]),
    ("Write to lena.o (at) lab.example instead, or bo AT lab DOT co DOT example. The server at 192.0.2.7 is down.", [("email", "lena.o (at) lab.example"), ("email", "bo AT lab DOT co DOT example")]),
    ("List-Post: <mailto:seq-list@lists.example.org>\n\nx", [("email", "seq-list@lists.example.org")]),
    ("Call me on +49 (30) 23125 468. Tel: (312) 555-0199\n312.555.0199 or ring 030/23125939 today.", [("phone", "+49 (30) 23125 468"), ("phone", "(312) 555-0199"), ("phone", "312.555.0199"), ("phone", "030/23125939")]),
    ("Parcel 3466 7054 9256 is on its way. Catalogue no. 53-69-1676 replaces K3.396.19. Invoice PO-51049, run 230110_QX45, version 2.0.25.", []),
    ("Payroll has SSN 945-12-3456 on file, tax id 28 661 792 864, NI number QQ 40 55 89 A and passport no.\n> C2106993.", [("id_number", "945-12-3456"), ("id_number", "28 661 792 864"), ("id_number", "QQ 40 55 89 A"), ("id_number", "C2106993")]),
    ("I have moved to 56 St. Orla Terrace, Pellmouth. Lieferung an Lindenweg 85, Oakhaven. Livraison au 86 bis bd du Moulin, Vallestra. Envíalo a Calle del Molino nº 13, Grisant.", [("address", "56 St. Orla Terrace"), ("address", "Lindenweg 85"), ("address", "86 bis bd du Moulin"), ("address", "Calle del Molino nº 13")]),
    ("Dear Dr. Kowalin,\n\nAccording to Lena Zubrin this is fine. Ask Zubrin, Lena or Lena T. Zubrin about it.", [("name", "Kowalin"), ("name", "Lena Zubrin"), ("name", "Zubrin, Lena"), ("name", "Lena T. Zubrin")]),  # surnames that no header shows
    ("> Lieferung bitte an\n>Am Steinbruch 69b, Mooswald. Envíalo a\n>Avda. de la Cantera nº 168, Pellmouth.", [("address", "Am Steinbruch 69b"), ("address", "Avda. de la Cantera nº 168")]),
    ("Content-Transfer-Encoding: base64\n\n" + "\n".join(["QmVu/Bo+" * 9] * 20) + "\nend", []),
]


@pytest.mark.parametrize(("text", "want"), SPANS)
def test_entities(text, want):
    model = pii.Model.load()
    assert [(k, text[s:e]) for s, e, k, _ in pii.find(text, GAZ, model)] == want


def test_chains_of_numbers():
    model = pii.Model.load()
    for text, want in (
        ("Tel: 01 23 45 67 89 06 12 34 56 78", ["01 23 45 67 89", "06 12 34 56 78"]), ("Call 020 7946 0958 020 7946 0959 today.", ["020 7946 0958", "020 7946 0959"]),
        ("Tel: 3 12 5 020 7946 0958", ["020 7946 0958"]), ("Call me on (312) 555-0199 (312) 555-0200", ["(312) 555-0199", "(312) 555-0200"]),
    ):
        assert [(k, text[s:e]) for s, e, k, _ in pii.find(text, GAZ, model)] == [("phone", x) for x in want]
        assert pii.redact(text, GAZ, model).count("[PHONE]") == len(want)
    chain = "12 345 6789 " * 40  # every run of whole groups of 7 to 15 digits within 32 characters
    groups = [(m.start(), m.end()) for m in pii._DIGITS.finditer(chain.strip())]
    runs = {(a, e) for i, (a, _) in enumerate(groups) for _, e in groups[i:] if e - a <= 32 and 7 <= sum(map(str.isdigit, chain[a:e])) <= 15}
    assert {(s, e) for s, e, k, _ in pii.candidates(chain.strip(), GAZ) if k == "phone"} == runs


def test_short_encoded_blocks_and_long_local_parts():
    model = pii.Model.load()
    block = "Content-Transfer-Encoding: base64\n\n" + "\n".join(["Lena" + "A/9" * 24] * 3) + "\nLena\n"
    assert len(block) < 1000 and not pii.candidates(block, GAZ) and pii.candidates(block.replace("base64", "8bit"), GAZ)
    for n in (63, 64, 65, 128, 500):
        text = f"Write to {'x' * n}@lab.example soon."
        assert [(k, text[s:e]) for s, e, k, _ in pii.find(text, GAZ, model)] == [("email", "x" * n + "@lab.example")]
    assert pii.redact(f"Write to {'bounce+' * 20}x (at) lab.example", GAZ, model) == "Write to [EMAIL]"


def test_redaction():
    model = pii.Model.load()
    assert pii.redact("Ask Lena Ortega (bo@x.example).\r\nOk", GAZ, model) == "Ask [NAME] ([EMAIL]).\r\nOk"
    assert pii.redact("", GAZ, model) == ""


def test_held_out_lines(monkeypatch):
    monkeypatch.setattr(pii_train, "KNOWN", 1.0)  # all names are in the gazetteer, as those of a corpus mostly are
    for kind, (right, got, true) in pii_train.accuracy(pii.Model.load().weights, 1500, 777, strangers=False).items():
        assert right / got > 0.97 and right / true > 0.97, kind


def test_training_and_marginals():
    weights = pii_train.train(lines=2500, epochs=4, seed=3)
    right, got, true = map(sum, zip(*pii_train.accuracy(weights, 400, 4).values()))
    assert right / got > 0.95 and right / true > 0.95
    # Marginals against the sum over all segmentations.
    spans = [(0, 3, "name", []), (2, 5, "name", []), (3, 6, "phone", []), (5, 7, "name", []), (0, 6, "email", [])]
    scores = [0.3, -0.2, 0.7, 0.1, 0.9]
    import itertools
    import math

    fits = [c for n in range(6) for c in itertools.combinations(range(5), n) if all(spans[a][1] <= spans[b][0] or spans[b][1] <= spans[a][0] for a, b in itertools.combinations(c, 2))]
    z = sum(math.exp(sum(scores[i] for i in c)) for c in fits)
    for i, p in enumerate(pii_train.marginals(spans, scores)):
        assert p == pytest.approx(sum(math.exp(sum(scores[j] for j in c)) for c in fits if i in c) / z)


def test_best_is_the_best():
    r = random.Random(4)
    import itertools

    for _ in range(200):
        spans = [(s := r.randrange(0, 12), s + r.randrange(1, 6), "name", [str(i)]) for i in range(7)]
        model = pii.Model({"name": {str(i): r.uniform(-1, 2) for i in range(7)}})
        fits = (c for n in range(8) for c in itertools.combinations(spans, n) if all(a[1] <= b[0] or b[1] <= a[0] for a, b in itertools.combinations(c, 2)))
        top = max(sum(model.score(k, f) for _, _, k, f in c) for c in fits)
        assert sum(model.score(k, f) for _, _, k, f in model.best(spans)) == pytest.approx(top)


def test_tables(spark):
    text = 'From: "Ortega, Lena" <lena@x.example>\nTo: Bo Stone <bo@x.example>\n\nAsk Lena Stone about it.\nBo'
    docs = spark.createDataFrame([(1, text, "a"), (1, text, "a"), (2, None, "b"), (3, "", "c"), (None, "Ask Lena about it.", "d"), (4, "x " * 300_000 + "Call me on +1 312 555 0199.", "e")], "doc_id long, text string, pii_type string")
    got = Counter(tuple(r) for r in pii.find_pii(docs).collect())
    one = [("email", "bo@x.example"), ("email", "lena@x.example"), ("name", "Bo"), ("name", "Bo Stone"), ("name", "Lena Stone"), ("name", "Ortega, Lena")]
    assert got == {(1, *x): 2 for x in one} | {(None, "name", "Lena"): 1, (4, "phone", "+1 312 555 0199"): 1}
    clean = {r.doc_id: r.text for r in pii.redact_pii(docs).collect()}
    assert clean[1] == 'From: "[NAME]" <[EMAIL]>\nTo: [NAME] <[EMAIL]>\n\nAsk [NAME] about it.\n[NAME]' and clean[2] is None and clean[3] == ""
    assert pii.find_pii(docs.limit(0)).count() == 0


def test_gazetteer(spark):
    docs = spark.createDataFrame([('From: "de la Quens, Zoë" <z@x.example>\r\nTo: a@y.example (Odile O\'Mara),\r\n\tMei Field <m@x.example>\r\n\r\nTo: Not Me <n@x.example>',), (None,), ("no header",)], "text string")
    gaz = pii.Gazetteer(pii.build_gazetteer(docs))
    assert {w: gaz.flags(w) for w in ("Zoë", "Quens", "la", "Odile", "O'MARA", "Mei", "field", "Not", "Me", "To")} == {"Zoë": "g", "Quens": "s", "la": "", "Odile": "g", "O'MARA": "s", "Mei": "g", "field": "s", "Not": "", "Me": "", "To": ""}
