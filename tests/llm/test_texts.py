"""Mixing, chats, pages, tokens, secrets, toxicity, search: brute force and edge cases."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import tiktoken
from oracle import compare
from pyspark.sql import functions as F

from skerry.llm import bpe, chat, html_extract, mixing, registry, secrets, topk, toxicity

EXTRA = "id string, name string, n long, t string, label string, taken long, position double, size long"


def frame(spark, rows, schema):
    """Rows with extra columns whose names clash with inner ones."""
    return spark.createDataFrame([(*r, "x", "y", 1, "z", "l", 2, 0.5, 3) for r in rows], f"{schema}, {EXTRA}")


# Mixing.


def test_mix_targets(spark):
    rows = [(i, "w " * (i % 7), s) for i, s in enumerate([None, "a", "b", "b", "b", "c", "é", "z"] * 40)] + [(None, "x y z", "a"), (5, None, "a"), (5, None, "a")]
    got = mixing.mix(frame(spark, rows, "doc_id long, text string, source string")).collect()
    assert len(got) == len(rows)
    source = defaultdict(set)
    for (i, _, s) in rows:
        source[i].add(s)
    taken, sizes, target = Counter(), Counter(), {}
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"] and len(r["positions"]) == (r["taken"] > 0) + (r["taken"] > r["size"])
        key = (r["source_size"], r["target"])
        taken[key] += r["taken"]
        sizes[key] += r["size"]
        target[key] = r["target"]
    total = sum(len((t or "").split()) for _, t, _ in rows)
    assert sum(target[k] * sizes[k] / k[0] for k in target if k[0]) == pytest.approx(1.5 * total)
    for k, v in target.items():
        assert v <= 2 * k[0] + 1e-9 and abs(taken[k] - v * sizes[k] / max(1, k[0])) < 2 * sizes[k] / max(1, k[0])
    assert mixing.mix(frame(spark, [], "doc_id long, text string, source string")).count() == 0


def test_curriculum_moves_heavy_sources_first(spark):
    rows = [(i, "w w w w", s) for i, s in enumerate(["a", "b", "c"] * 300)]
    got = mixing.mix(frame(spark, rows, "doc_id long, text string, source string")).select("doc_id", F.explode("positions").alias("p")).collect()
    mean = [np.mean([r["p"] for r in got if r["doc_id"] % 3 == k]) for k in range(3)]
    assert mean[0] < mean[1] < mean[2] and all(0 <= r["p"] <= 1 for r in got)


def test_second_copies_stand_in_the_second_pass(spark):
    """A source that is taken twice spans all of training, and each tenth holds the share that its schedule gives it."""
    rows = [(i, "w " * 10, "a") for i in range(1000)] + [(5000 + i, "w " * 10, "b") for i in range(9000)]
    found = mixing.mix(frame(spark, rows, "doc_id long, text string, source string")).filter("doc_id < 5000").collect()
    assert all(r["taken"] == 20 and len(r["positions"]) == 2 and r["positions"][0] < r["positions"][1] for r in found)
    places = np.sort([p for r in found for p in r["positions"]])
    assert places[0] < 0.002 and places[-1] > 0.998
    reach = lambda t: (6 * t - t * t) / 5
    for k in range(10):
        share = ((places >= k / 10) & (places < (k + 1) / 10)).mean()
        assert share == pytest.approx(reach((k + 1) / 10) - reach(k / 10), abs=0.002)
    # Copies k of a document are a whole pass of the source apart.
    assert all(reach(r["positions"][1]) - reach(r["positions"][0]) == pytest.approx(0.5, abs=1e-9) for r in found)


def test_repeated_rows_are_mixed_as_often_as_they_stand(spark):
    rows = [(1, "w w", "a")] * 5 + [(1, "w w", "b"), (None, "w w", None), (None, "w w", None), (2, None, "a")]
    docs = frame(spark, rows, "doc_id long, text string, source string")
    want = Counter()
    for r in mixing.mix(docs).filter("taken > 0").collect():
        want[(r["doc_id"], r["source"])] += max(1, round(r["taken"] / r["size"]))
    assert Counter((r["doc_id"], r["source"]) for r in mixing.apply_mix(docs).collect()) == want


def test_mix_stage_and_oracle(spark, sf):
    rows = [(i, "w " * 5, s) for i, s in enumerate(["a", "b", "c", None] * 50)]
    docs = frame(spark, rows, "doc_id long, text string, source string")
    mixed = mixing.apply_mix(docs)
    assert mixed.columns == docs.columns
    assert {r["doc_id"] for r in mixed.collect()} == {r["doc_id"] for r in mixing.mix(docs).filter("taken > 0").collect()}
    compare(registry.queries()["op4_mixing"](spark, sf), mixing.ORACLE_SQL, sf)


# Chats.

EVENTS = "conv_id long, msg_id string, seq long, kind string, role string, text string"


def chats(spark, rows):
    formatted = chat.format_chats(frame(spark, rows, EVENTS)).withColumn("turns", chat.read_back(F.col("formatted")))
    return {r["conv_id"]: [(t["role"], t["text"]) for t in r["turns"]] for r in formatted.collect()}


def test_events_fold(spark):
    rows = [
        (1, "u", 1, "message", "user", "hi"), (1, "a", 2, "message", "assistant", "He"), (1, "a", 3, "delta", None, "llo"), (1, "a", 5, "regenerate", None, "Good "), (1, "a", 6, "delta", None, "day"),
        (1, "u", 7, "edit", None, "hi!"), (1, "x", 8, "message", "user", "gone"), (1, "x", 9, "delete", None, None), (2, "d", 2, "delta", None, "b"), (2, "d", 1, "delta", "assistant", "a"), (3, "n", 1, None, None, None),
    ]
    assert chats(spark, rows) == {1: [("user", "hi!"), ("assistant", "Good day")], 2: [("assistant", "ab")], 3: [("", "")]}
    assert chats(spark, []) == {}


def test_control_strings_survive(spark):
    r = random.Random(3)
    texts = ["".join(r.choice(["\\", "### ", "</turn>", "\n", " ", "a", ":", "#", "<", "\\###", "é"]) for _ in range(r.randrange(12))) for _ in range(300)]
    rows = [(i // 3, str(i), i, "message", texts[-i], t) for i, t in enumerate(texts)]
    want = {}
    for c, _, _, _, role, text in rows:
        want.setdefault(c, []).append((role, text))
    assert chats(spark, rows) == want


def test_ties_go_by_the_text_itself(spark):
    rows = [(1, "a", 1, "message", "user", "### x"), (1, "b", 1, "message", "user", "$ y"), (1, "c", 1, "message", "user", "\\z"), (1, "d", 1, "message", "user", "Z")]
    assert chats(spark, rows)[1] == sorted(("user", r[5]) for r in rows)


def test_repeated_turns_stay(spark):
    turns = frame(spark, [(1, 0, "user", "a")] * 2 + [(1, 1, "assistant", None), (None, 0, "user", "b")], "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r["n_turns"] for r in chat.digests(chat.format_chats(chat.as_events(turns))).collect()}
    assert got == {1: 3, None: 1}


def test_chat_oracle(spark, sf):
    compare(registry.queries()["op5_chat"](spark, sf), chat.ORACLE_SQL, sf)


# Main text.


def test_blocks():
    long = "The quick brown fox and the lazy dog met in the old town, and all of them had a long talk about the weather and the news of the day."
    page = f"""<html><head><title>T</title></head><body class="x"><header>Top of the page</header><nav><a href=/>Home</a></nav><div class="cookie-notice">We use the cookies that are of use</div>
    <article><h1>A &amp; B</h1><p>{long}<p>Short&nbsp;<b>bo</b>ld<br>line <ul><li>one<li>two</ul><aside>side</aside><form>Sign up<input></form><script>if (a < b) "</p>"</script>
    <p><a href=x>{long}</a></p><p>{long} <i>x</p><div id="comments"><p>{long}</p></div></article><footer>&copy; foot</footer>"""
    assert html_extract.extract(page).split("\n") == ["A & B", long, "Short bold line", "one", "two", long + " x"]
    plain = f"<div>menu</div><div><p>{long}</p><p>ok then</p><p>{long}</p></div><div><a>x</a> <a>y</a></div>"
    assert html_extract.extract(plain).split("\n")[-3:] == [long, "ok then", long]
    assert html_extract.extract("") == "" and html_extract.extract("a < b") == ""
    assert html_extract.extract("<article><p>x &am") == "x &am" and html_extract.extract("<article>" + "<b>" * 5000 + "deep") == "deep"


def test_rules_decide_without_marks():
    """On every page, the rules alone find the marked article's text again once its marks are gone."""
    import duckdb

    same = total = extra = 0
    for (html,) in duckdb.sql("SELECT html FROM '/root/testdata/sf0.01/pages.parquet'").fetchall():
        want = html_extract.extract(html).split("\n")
        bare = html_extract.extract(html.replace("<article", "<div").replace("</article", "</div").replace("<main", "<div").replace("</main", "</div")).split("\n")
        missing, more = Counter(want) - Counter(bare), Counter(bare) - Counter(want)
        total += sum(map(len, want))
        same += sum(map(len, want)) - sum(map(len, missing.elements()))
        extra += sum(map(len, more.elements()))
    assert same / total >= 0.98 and extra / total < 0.02


def test_rules_drop_what_structure_does_not_name():
    text = "The river was high and the men of the town had come to see it, for it was the first time in years that it had been so."
    links = "".join(f"<a href=/{i}>A longer title of some other story of ours number {i}</a> " for i in range(4))
    page = f"<div><p>{text}</p><p>Short one</p><p>{text}</p><div>{links}</div><div>See also</div><div>{links}</div></div>"
    assert html_extract.extract(page).split("\n") == [text, "Short one", text]
    assert html_extract.extract(f"<article>{page}</article>").split("\n") == [text, "Short one", text]
    table = "kvar | zonk | brul | plimf | grosk | tarv | zimb | quorl | fnord | blat | wex | yorp | kvar"
    assert html_extract.extract(f"<div><p>{text}</p><div>{table}</div></div>").split("\n") == [text, table]
    other = "Река поднялась высоко, и жители города пришли посмотреть на нее, потому что такого не было много лет подряд."
    assert html_extract.extract(f"<div><p>{other}</p><p>Да</p><div>{links}</div></div>").split("\n") == [other, "Да"]


def test_pages_query(spark, sf):
    rows = [(1, "u", None), (2, "u", "<article>" + "<p>word word</p>" * 20000), (2, "u", "<article>a"), (None, None, "<article>a")]
    got = html_extract.main_text(frame(spark, rows, "page_id long, url string, html string")).collect()
    assert sorted(r["n_chars"] for r in got) == [0, 1, 1, 20000 * 10 - 1]
    assert html_extract.main_text(frame(spark, [], "page_id long, url string, html string")).count() == 0
    found = registry.queries()["op7_html"](spark, sf).collect()
    assert all(r["text"] and len(r["text"]) == r["n_chars"] and "<" not in r["text"] for r in found)


# Tokens.


@pytest.fixture(scope="module")
def vocabulary():
    import public_tokenizers as p

    path = p.path("byte_bpe_50k.tiktoken")
    return path, p.PATTERN, tiktoken.Encoding("own", pat_str=p.PATTERN, mergeable_ranks=bpe.load_ranks(path), special_tokens={})


def texts(n):
    r = random.Random(5)
    return ["".join(r.choice("ab \n\t\x1c\x85éß中😀́'s1²½ⅷ.abcdefgh") for _ in range(r.randrange(120))) for _ in range(n)] + ["", "a" * 3000, "'s't're", "bcbcbcbc abcbc", "<|endoftext|>"]


def test_replay(vocabulary):
    path, pattern, library = vocabulary
    encoder = bpe.Encoder(path, pattern, kept=50)
    for text in texts(300):
        (words,) = encoder.split_all([text])
        assert [i for w in words for i in encoder.ids[w]] == library.encode_ordinary(text)


def test_replay_with_ranks_out_of_order(tmp_path):
    import base64

    tokens = [bytes((c,)) for c in range(256)] + [b"abc", b"bc", b"ab", b"cab", b"bca", b"abcabc", b"cc"]
    path = tmp_path / "ranks"
    path.write_text("".join(f"{base64.b64encode(t).decode()} {i}\n" for i, t in enumerate(tokens)))
    library = tiktoken.Encoding("x", pat_str=r"\S+|\s+", mergeable_ranks=bpe.load_ranks(str(path)), special_tokens={})
    encoder, r = bpe.Encoder(str(path), r"\S+|\s+"), random.Random(1)
    for _ in range(500):
        text = "".join(r.choice("abc") for _ in range(r.randrange(1, 30)))
        encoder.split_all([text])
        assert encoder.ids[text] == library.encode_ordinary(text)


def test_tokens_query(spark, sf, vocabulary):
    path, pattern, library = vocabulary
    rows = [*((i, t) for i, t in enumerate(texts(20))), (None, "x"), (1, None), (1, None)]
    docs = frame(spark, rows, "doc_id long, text string")
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = Counter()
    for i, t in rows:
        ids = library.encode_ordinary(t or "")
        want[(i, len(ids), sha(" ".join(map(str, ids)).encode()), sha((t or "").encode()))] += 1
    assert Counter(map(tuple, bpe.digests(docs, path, pattern).collect())) == want
    encoded = bpe.decode(bpe.encode(docs, path, pattern), path)
    assert all(bytes(r["decoded"]).decode() == (r["text"] or "") for r in encoded.collect())
    assert bpe.digests(frame(spark, [], "doc_id long, text string"), path, pattern).count() == 0
    found = {r["doc_id"]: r for r in registry.queries()["op8_bpe"](spark, sf).collect()}
    for i, t in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect():
        assert found[i]["n_tokens"] == len(library.encode_ordinary(t)) and found[i]["decoded_sha256"] == sha(t.encode())


# Secrets.


def test_base_findings():
    key = "AKIA" + "B" * 16
    text = f'Password = "abcdef" secret: token: abcdefgh {key} {"0123456789abcdef" * 2} token=12345 API_KEY:"x/y+z=="'
    assert [(text[a:b], k) for a, b, k in secrets.base_findings(text)] == [
        ('Password = "abcdef', "assign"), (key, "access"), ("0123456789abcdef" * 2, "hex"), ('API_KEY:"x/y+z==', "assign"),
    ]
    assert secrets.base_findings("paſſword=abcdefg") == [] and secrets.base_findings("") == []


def test_network_learns():
    r = random.Random(2)
    hexes = ["".join(r.choice("0123456789abcdef") for _ in range(40)) for _ in range(120)]
    words = ["".join(r.choice(["ening", "tion", "re", "the"]) for _ in range(6))[:24].ljust(16, "e") for _ in range(120)]
    piece = lambda before, x: (before + x + " after it", len(before), len(before) + len(x))
    network = secrets.fit([piece('a token = "', x) for x in hexes[:80]], [piece("some words ", x) for x in words[:80]])
    score = lambda x: network.scores(secrets.encode([piece("plain text ", x)]))[0] >= network.threshold
    assert sum(map(score, hexes[80:])) >= 38 and sum(map(score, words[80:])) <= 2
    assert secrets.fit([piece("a", "b" * 16)], []) is None
    analytic = network._gradients(secrets.encode([piece("x ", hexes[0])]), np.array([0.0]))
    for name in ("conv", "out", "bias"):
        at, step = np.unravel_index(np.abs(analytic[name]).argmax(), analytic[name].shape), 1e-5
        losses = []
        for sign in (1, -1):
            network.p[name][at] += sign * step
            z = network.logits(secrets.encode([piece("x ", hexes[0])]))[0]
            losses.append(np.log1p(np.exp(z)))
            network.p[name][at] -= sign * step
        assert analytic[name][at] == pytest.approx((losses[0] - losses[1]) / (2 * step), rel=1e-3, abs=1e-8)


def scanned(text):
    """The base findings once more, character by character."""
    found, wide = [], set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")

    def runs(at, chars):
        end = at
        while end < len(text) and text[end] in chars:
            end += 1
        return end

    i = 0
    while i < len(text):
        word = next((w for w in ("password", "passwd", "secret", "token", "api_key", "apikey") if text[i : i + len(w)].isascii() and text[i : i + len(w)].lower() == w), None)
        at = i + len(word or "")
        at += text[at : at + 1] in ("'", '"') and word is not None
        at = runs(at, " ")
        if word and text[at : at + 1] in (":", "="):
            at = runs(at + 1, " ")
            at += text[at : at + 1] in ("'", '"')
            end = runs(at, wide)
            if end > at:
                found += [(i, end, "assign")] * (end - at >= 6)
                i = end
                continue
        i += 1
    for kind, head, chars, least in (("access", "AKIA", set("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"), 20), ("hex", "", set("0123456789abcdef"), 24)):
        i = 0
        while i < len(text):
            end = runs(i + len(head), chars) if text.startswith(head, i) else i
            if end > i + len(head):
                found += [(i, end, kind)] * (end - i >= least)
                i = end
            else:
                i += 1
    return sorted(found, key=lambda s: (s[0], ("assign", "access", "hex").index(s[2])))


def test_network_adds_other_kinds(spark):
    """Secrets that no pattern names, in documents of their own: how many the network adds, and how much else."""
    r = random.Random(11)
    key = lambda n: "".join(r.choice("ABCDEFGHJKMNPQRSTVWXYZabcdefghijkmnopqrstuvwxyz0123456789") for _ in range(n))
    word = lambda: "".join(r.choice(["tion", "er", "an", "the", "in", "on", "re"]) for _ in range(7))
    plain = lambda: r.choice([f"{word()}-{word()}", f"www.{word()}.com/{word()}", f"{word()}_{word()}.html", word() + word()])
    prose = lambda: " ".join(word()[: r.randrange(2, 9)] for _ in range(12))
    rows = [(i, f"{prose()} {r.choice(['token', 'secret', 'api_key'])} = {key(32)} {prose()} {plain()} {prose()}") for i in range(400)]
    rows += [(1000 + i, f"{prose()} {plain()} {prose()}") for i in range(600)] + [(2000 + i, f"{prose()} {key(36)} {prose()}") for i in range(20)]
    found = {x["doc_id"]: x["n_model"] for x in secrets.find_secrets(frame(spark, rows, "doc_id long, text string")).collect()}
    recall, wrong = np.mean([found[2000 + i] for i in range(20)]), np.mean([found[1000 + i] for i in range(600)])
    assert recall >= 0.9 and wrong <= 0.05, (recall, wrong)


def test_every_piece_counts(spark, monkeypatch):
    """Copies crowd no other piece out of what is learned, however it is dealt to tasks."""
    r = random.Random(5)
    key = lambda: "".join(r.choice("ABCDEFGHJKMNPQRSTVWXYZabcdefghijkmnopqrstuvwxyz0123456789") for _ in range(32))
    word = lambda: "".join(r.choice(["tion", "er", "an", "the", "in", "on", "re"]) for _ in range(7))
    prose = lambda: " ".join(word()[: r.randrange(2, 9)] for _ in range(12))
    rows = [(i, f"{prose()} token = {key()} {prose()}") for i in range(400)]
    other = lambda: r.choice([word() + word(), f"www.{word()}.com/{word()}", f"{r.randrange(10**19, 10**20)}", f"build-{key()[:12]}.jar"])
    rows += [(1000 + i, f"{prose()} {other()} {prose()}") for i in range(600)]
    pieces = secrets.different_pieces(secrets.scan(frame(spark, rows, "doc_id long, text string"), "doc_id", "text"))
    first = pieces.filter("not label").orderBy("mark").first()["t"]
    rows += [(9000 + i, next(t for _, t in rows if first in t)) for i in range(1600)]
    docs = frame(spark, rows, "doc_id long, text string")
    expected = Counter((p["t"], p["a"], p["b"], c["label"]) for _, t in rows for c in secrets.candidates(t, secrets.base_findings(t)) for p in c["pieces"])
    learned, held, counts = secrets.split(secrets.different_pieces(secrets.scan(docs, "doc_id", "text")))
    parts = [{(x["t"], x["a"], x["b"], x["label"]): x["n"] for x in d.collect()} for d in (learned, held)]
    assert parts[0] | parts[1] == expected and not parts[0].keys() & parts[1].keys()
    assert counts == [sum(k[3] == label for k in parts[0]) for label in (True, False)] and len(parts[1]) == pytest.approx(len(expected) / 5, rel=0.2)
    for chunk in (secrets.CHUNK, 300):
        monkeypatch.setattr(secrets, "CHUNK", chunk)
        found = {x["doc_id"]: x for x in secrets.find_secrets(docs).collect()}
        assert np.mean([found[1000 + i]["n_model"] for i in range(600)]) <= 0.05 and sum(found[i]["n_assign"] for i in range(400)) == 400


def test_secrets_query(spark, sf):
    rows = [(1, None), (2, ""), (3, "x" * 100000), (None, "token=abcdef"), (5, "token=abcdef"), (5, "token=abcdef")]
    got = {r["doc_id"]: r["n_assign"] for r in secrets.find_secrets(frame(spark, rows, "doc_id long, text string")).collect()}
    assert got == {1: 0, 2: 0, 3: 0, None: 1, 5: 1}
    assert secrets.find_secrets(frame(spark, [], "doc_id long, text string")).count() == 0
    sf = sf.replace("0.001", "0.01")
    found = {r["doc_id"]: r for r in registry.queries()["op9_secrets"](spark, sf).collect()}
    for i, t in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect():
        base = scanned(t)
        assert found[i]["base_sha256"] == hashlib.sha256(secrets.joined(base).encode()).hexdigest()
        assert set(secrets.joined(base).split(",")) <= set(found[i]["spans"].split(","))
    import duckdb

    word = "(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
    counts = duckdb.sql(f"""SELECT doc_id, len([x FOR x IN regexp_extract_all(text, '{word}["'']? *[:=] *["'']?([A-Za-z0-9+/_.=-]+)', 1) IF length(x) >= 6]),
        len([x FOR x IN regexp_extract_all(text, 'AKIA[A-Z0-9]+') IF length(x) >= 20]), len([x FOR x IN regexp_extract_all(text, '[0-9a-f]+') IF length(x) >= 24])
        FROM '{sf}/documents.parquet'""").fetchall()
    assert all((found[i]["n_assign"], found[i]["n_access"], found[i]["n_hex"]) == tuple(n) for i, *n in counts) and sum(map(sum, (n for _, *n in counts))) > 0


# Toxicity.


def test_forward_backward_is_exact():
    r = np.random.default_rng(1)
    counts, move = np.array([0, 3, 1, 5, 3, 0]), r.normal(size=(2, 2))
    unary = r.normal(size=counts.sum())
    likely, expected = toxicity.forward_backward(unary, counts, move, True)
    pairs, at = np.zeros((2, 2)), 0
    for n in counts.tolist():
        total, marginal, seen = 0.0, np.zeros(n), np.zeros((2, 2))
        for code in range(2**n):
            tags = [code >> k & 1 for k in range(n)]
            weight = np.exp(sum(unary[at + k] * tags[k] for k in range(n)) + sum(move[a, b] for a, b in zip(tags, tags[1:], strict=False)))
            total += weight
            marginal += weight * np.array(tags)
            for a, b in zip(tags, tags[1:], strict=False):
                seen[a, b] += weight
        assert likely[at : at + n] == pytest.approx(marginal / total)
        pairs += seen / total
        at += n
    assert expected == pytest.approx(pairs) and len(toxicity.forward_backward(np.zeros(0), np.zeros(2, dtype=np.int64), move)[0]) == 0


def test_a_document_is_one_chain():
    """A token's marginal depends on what stands hundreds of tokens before it, wherever blocks end."""
    field = toxicity.Field()
    field.bias, field.transition, field.weight = 0.0, np.array([[6.0, -6.0], [-6.0, 6.0]]), {"=start": 30.0}
    one, other = (field.summary([w + " x" * 400])[1][0] for w in ("start", "x"))
    assert one[300] > 0.7 > 0.6 > other[300]


def test_sample_is_whole_and_bounded(spark):
    texts = {i: f"word{i} " * 3000 for i in range(40)}
    docs = frame(spark, [*texts.items(), (3, "zz"), (41, " Same  text"), (42, "same TEXT "), *[(43, "again and again")] * 50, (None, "x"), (44, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in [*range(45), 41]], "doc_id long, toxic int")
    got, marks, share = toxicity.sample(docs, labels, "doc_id", "text", "toxic", 100)
    learned = [i for i in range(45) if i != 40 and zlib.crc32(str(i).encode()) % 4 != 2]
    assert len(got) == len(learned) and all(t in {"zz", "again and again", "", " Same  text", "same TEXT ", *texts.values()} for t in got)
    assert len(marks) == len(got) and 0 < share < 1
    few, _, _ = toxicity.sample(docs, labels, "doc_id", "text", "toxic", 100, chars=120_000)
    assert 0 < sum(map(len, few)) <= 120_000 and len(toxicity.sample(docs, labels, "doc_id", "text", "toxic", 3)[0]) == 6


def test_toxic_spans_and_edges(spark):
    r = random.Random(4)
    word = lambda: "".join(r.choice(["an", "or", "the", "ti", "en"]) for _ in range(3))
    docs, labels = [], []
    for i in range(240):
        tokens = [word() for _ in range(40)]
        if i % 4 == 0:
            for k in (5, 6, 20):
                tokens[k] = r.choice(["vilewort", "grimzag"])
        docs.append((i, " ".join(tokens)))
        labels.append((i, int(i % 4 == 0)))
    docs += [(1000, None), (1001, ""), (1002, "vilewort grimzag " * 5000), (None, "grimzag"), (1003, "x" * 50000)]
    labels += [(1000, None), (5, None), (None, 1)]
    found = {x["doc_id"]: x for x in toxicity.toxicity(frame(spark, docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    assert len(found) == len(docs) and found[1000]["score"] == found[1001]["score"] < 0.3 and found[1002]["predicted"] == 1
    held = [i for i in range(240) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(found[i]["held_out"] for i in held) and np.mean([found[i]["predicted"] == (i % 4 == 0) for i in held]) > 0.95
    marked = [(text[a:b].split(), i) for i, text in docs[:240] for a, b in (map(int, s.split(":")) for s in found[i]["spans"].split(",") if s)]
    assert all(w in ("vilewort", "grimzag") for tokens, _ in marked for w in tokens) and len({i for _, i in marked}) > 50
    kept = toxicity.drop_toxic(frame(spark, docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert kept.count() == sum(x["predicted"] == 0 for x in found.values())


def test_toxicity_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r["score"] for r in toxicity.toxicity(frame(spark, [(1, "a")], "doc_id long, text string"), none).collect()] == [0.0]
    assert toxicity.toxicity(frame(spark, [], "doc_id long, text string"), none).count() == 0


def test_toxicity_held_out():
    import duckdb

    d = "/root/testdata/sf0.1"
    rows = duckdb.sql(f"SELECT min(doc_id), toxic, text FROM '{d}/documents.parquet' JOIN '{d}/labels.parquet' USING (doc_id) GROUP BY toxic, text ORDER BY 1").fetchall()
    fold = lambda i: zlib.crc32(str(i).encode()) % 4
    learn = [x for x in rows if fold(x[0]) != 2]
    field = toxicity.train([x[2] for x in learn], [x[1] for x in learn])
    rest = [x for x in rows if fold(x[0]) == 2]
    hit = field.scores(field.summary([x[2] for x in rest])[0]) >= toxicity.THRESHOLD
    y = np.array([x[1] for x in rest]) == 1
    assert hit[y].mean() > 0.9 and hit[~y].mean() < 0.02
    # The true share moves all scores by the difference of the log odds.
    part = [x for x in learn if x[1] == 1][:60] + [x for x in learn if x[1] == 0][:60]
    few, half = (toxicity.train([x[2][:2000] for x in part], [x[1] for x in part], share=share) for share in (0.1, 0.5))
    figures = few.summary([x[2] for x in rest[:50]])[0]
    logit = lambda p: np.log(p / (1 - p))
    assert logit(half.scores(figures)) - logit(few.scores(figures)) == pytest.approx(np.log(9), rel=1e-6)


# Search.


def brute(rows, k, is_query):
    out = Counter()
    usable = [(i, [int(np.floor(64 * float(x))) for x in v]) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    for q, v in dict((i, v) for i, v in usable if is_query(i)).items():
        scores = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in usable if i != q and len(w) == len(v))
        for rank, (s, i) in enumerate(scores[:k], 1):
            out[(q, rank, i, -s)] += 1
    return out


@pytest.mark.parametrize("pivots,chunk", [(4096, 4096), (3, 10)])
def test_top_k(spark, pivots, chunk):
    r = np.random.default_rng(3)
    rows = [(i, r.normal(size=8).tolist()) for i in range(200)] + [(200 + i, [1.0] * 8) for i in range(60)]
    rows += [(300, None), (301, []), (302, [None] * 8), (303, [float("nan")] * 8), (304, [float("inf")] * 8), (305, [1.0, 2.0]), (310, [3.0, 4.0]), (None, [0.0] * 8), (7, rows[7][1]), (320, [4e6] * 8), (321, [-4e6] * 8), (330, [1e9, 1.0]), (331, [1.0, 1.0]), (332, [-3.0, 5.0])]
    got = topk.top_k(frame(spark, rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 10 == 0, k=7, pivots=pivots, chunk=chunk).collect()
    assert Counter(map(tuple, got)) == brute(rows, 7, lambda i: i % 10 == 0)


def test_repeated_queries_and_overflow(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.5, 9.0]), (1, [2.0, 1.0]), (2, [1.0, 1.0]), (2, [1.0, 1.0])]
    got = [tuple(r) for r in topk.top_k(frame(spark, rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0, k=3).orderBy("rank").collect()]
    assert got in ([(0, 1, 1, 128 * 64), (0, 2, 2, 64 * 64), (0, 3, 2, 64 * 64)], [(0, 1, 1, 128 * 32 + 64 * 576), (0, 2, 2, 64 * 32 + 64 * 576), (0, 3, 2, 64 * 32 + 64 * 576)])
    for far in ([1e18, 1e18], [1e10, 1e10]):
        with pytest.raises(Exception, match="fit a 64-bit integer"):
            topk.top_k(frame(spark, [(0, far), (1, far)], "vec_id long, embedding array<double>"), F.col("vec_id") == 0).collect()


def test_top_k_query(spark, sf):
    compare(registry.queries()["op10_topk"](spark, sf), topk.ORACLE_SQL, sf)
    assert topk.top_k(frame(spark, [], "vec_id long, embedding array<float>"), F.col("vec_id") == 0).count() == 0
