"""Cross-tokenizer alignment against byte offsets compared pair by pair."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from millrace.llm import token_alignment as A

FILES = A.public_files()


def offsets(ids, spelled):
    at, out = 0, []
    for i in ids:
        out.append((at, at + len(spelled[i])))
        at += len(spelled[i])
    return out


def plain(text, made=[]):  # noqa: B006  the tokenizers are loaded once
    """Ids, groups and links of a text by the libraries on the whole text and by comparing offsets."""
    if not made:
        made += [Tokenizer.from_file(FILES[0]), sentencepiece.SentencePieceProcessor(model_file=FILES[1]), A.aligner(FILES)]
        made[0].encode_special_tokens = True
    if not text:
        return [], [], [], []
    a, b = made[0].encode(f" {text}", add_special_tokens=False).ids, made[1].encode(text)
    spelled_a, spelled_b = made[2].a.bytes, made[2].b.bytes
    whole = f" {text}".encode()
    if b"".join(spelled_a[i] for i in a) != whole or b"".join(spelled_b[i] for i in b) != whole:
        return [], [], [], []
    at_a, at_b = offsets(a, spelled_a), offsets(b, spelled_b)
    both = sorted({e for _, e in at_a} & {e for _, e in at_b})
    groups, low = [], 0
    for end in both:
        groups.append(([i for i, (s, e) in zip(a, at_a, strict=True) if low < e <= end], [i for i, (s, e) in zip(b, at_b, strict=True) if low < e <= end]))
        low = end
    links = [(i, j) for i, (s, e) in zip(a, at_a, strict=True) for j, (t, f) in zip(b, at_b, strict=True) if s < f and t < e]
    return a, b, groups, links


def expected(texts):
    made = [plain(t) for t in texts]
    held = Counter(p for m in made for p in set(m[3]))
    best = defaultdict(int)
    for (a, _), n in held.items():
        best[a] = max(best[a], n)
    out = []
    for a, b, groups, links in made:
        said = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        out.append((len(a), len(b), len(groups), len(links), sum(held[p] == best[p[0]] for p in links), sum(held[p] for p in links), hashlib.sha256(said.encode()).hexdigest() if said else ""))
    return out


ODD = [None, "", " ", "\n", "a", "  a  b ", "a ", "\n\n x  ", "<|endoftext|> <s> </s> <unk>", "▁x y", "é́ ﬁ x", "中文 テ", "x y \t z", "'s it's  'S", "a　b", "☃ 😀😀", "<0x41> a", "\x00a b\x00", "a\r\n b", "x \xa0 y", "a", "a", "the quick brown fox " * 9, "\x1c b \x1d c"]


def test_figures_match_offsets(spark, monkeypatch):
    monkeypatch.setattr(A, "CHUNK_ROWS", 7)  # several chunks
    docs = [(i, t, "other") for i, t in enumerate(ODD)] + [(None, "no id", "other"), (3, "an id twice", "other")]
    frame = spark.createDataFrame(docs, "doc_id long, text string, n_a string").repartition(3)
    found = sorted(map(tuple, A.link_counts(frame, FILES).collect()), key=repr)
    assert found == sorted(((d[0], *e) for d, e in zip(docs, expected([d[1] for d in docs]), strict=True)), key=repr)
    assert not any(x for r in found if r[0] == ODD.index("▁x y") for x in r[1:])


def test_documents_of_the_table(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").orderBy("doc_id").limit(60)
    rows = [(r.doc_id, r.text) for r in docs.collect() if len(r.text or "") < 6000]
    found = sorted(map(tuple, A.link_counts(spark.createDataFrame(rows, "doc_id long, text string"), FILES).collect()))
    assert found == sorted((r[0], *e) for r, e in zip(rows, expected([r[1] for r in rows]), strict=True))


@settings(max_examples=60, deadline=None)
@given(st.text(st.sampled_from("ab é\n\t.'  1日​"), max_size=30))
def test_any_text(text):
    made = plain(text)
    found = A.aligner(FILES).figures([text])[0]
    assert (found[:3] if found else (0, 0, 0)) == (len(made[0]), len(made[1]), len(made[2]))


def test_groups_and_long_text(spark):
    text = "word and another, " * 20_000 + "x" * 300_000
    r = A.token_groups(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string"), FILES).orderBy("doc_id").collect()
    assert r[0].a_ends[-1] == len(r[0].a_ids) and r[0].b_ends[-1] == len(r[0].b_ids) and list(r[1])[1:] == [[], [], [], []]
    spelled = A.aligner(FILES)
    i, j = 0, 0
    for to_i, to_j in zip(r[0].a_ends, r[0].b_ends, strict=True):
        assert b"".join(spelled.a.bytes[x] for x in r[0].a_ids[i:to_i]) == b"".join(spelled.b.bytes[x] for x in r[0].b_ids[j:to_j])
        i, j = to_i, to_j


def test_memo_in_generations(monkeypatch):
    monkeypatch.setattr(A, "MEMO", 2)
    small = A.Aligner(FILES)
    texts = ["one two three", "two three four", "one one", "five"]
    assert [small.figures([t]) for t in texts] == [A.aligner(FILES).figures([t]) for t in texts]


def test_new_stretches_share_texts(monkeypatch):
    """Both tokenizers get new words a hundred at a time; one text for each went beyond the CPU budget."""
    small, sent = A.Aligner(FILES), []
    for side in ("a", "b"):
        monkeypatch.setattr(small, side, Counted(getattr(small, side), sent))
    words = [f"w{n}ord{n * 7}," for n in range(1000)]
    assert small.figures([" ".join(words)]) == A.aligner(FILES).figures([" ".join(words)])
    assert sum(sent) <= 2 * 11


class Counted:
    """A side that notes how many texts it is given."""

    def __init__(self, side, sent):
        self.side, self.sent = side, sent

    def __call__(self, texts):
        self.sent.append(len(texts))
        return self.side(texts)

    def __getattr__(self, name):
        return getattr(self.side, name)


@pytest.mark.parametrize("odd", ["\u2581x", "\ufb01n", "e\u0301", "tail\x1c", "\n", "x" * 300, "\u4e2d\u6587", "<s>"])
def test_odd_stretch_leaves_its_neighbours(odd):
    texts = [f"{odd[::-1]}a{n} b{n},{n}" if n % 2 else f"c{n}" for n in range(150)]
    texts[70:70] = [odd, f"d {odd}", f"{odd} e"]
    found = A.Aligner(FILES).figures(texts)
    for text, f in zip(texts, found, strict=True):
        a, b, groups, links = plain(text)
        said = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        assert (f or (0, 0, 0, "", b"")) == (len(a), len(b), len(groups), said, b"".join((i << A.BITS | j).to_bytes(8, "little") for i, j in links))


def test_side_that_changes_letters(monkeypatch):
    """Joined texts fail where a side's normalisation changes a letter; that stretch alone has no tokens."""
    small, sound = A.Aligner(FILES), A.aligner(FILES)
    monkeypatch.setattr(small, "b", Lowered(small.b, []))
    texts = [f"a{n} Q{n}" if n % 40 == 7 else f"a{n} q{n}" for n in range(400)]
    found = small.figures(texts)
    assert found == [None if "Q" in t else f for t, f in zip(texts, sound.figures(texts), strict=True)]


class Lowered(Counted):
    def __call__(self, texts):
        return self.side([t.replace("Q", "q") for t in texts])


def test_in_step_as_one_by_one(monkeypatch):
    monkeypatch.setattr(A, "SLOT_BITS", 2)  # transitions push each other out
    side_a, side_b = [b"", b"a", b"ab", b"b", b"bc", b"c", b"abc"], [b"", b"ab", b"c", b"a", b"bca", b"b", b"ca"]
    draw = np.random.default_rng(5)
    made = [(draw.integers(1, 7, draw.integers(1, 6)).tolist(), draw.integers(1, 7, draw.integers(1, 6)).tolist()) for _ in range(3000)]
    made += [([6, 6], [1, 6, 1, 2]), ([0], [0]), ([1, 4], [1, 2]), ([2], [1])] * 3
    both = A.Transducer(side_a, side_b)
    borders = [np.cumsum([0, *(len(m[k]) for m in made)]) for k in (0, 1)]
    good, ends_a, ends_b, links, of = both.run_all(*(np.concatenate([m[k] for m in made]) for k in (0, 1)), *borders)
    alone = [A.Transducer(side_a, side_b).run(*m) for m in made]
    assert good.tolist() == [x is not None for x in alone] and 20 < good.sum() < len(made)
    ends = list(zip(ends_a.tolist(), ends_b.tolist(), strict=True))
    for n, x in enumerate(alone):
        low, high, start = borders[0][n], borders[0][n + 1], (borders[0][n], borders[1][n])
        of_it = [(i - start[0], j - start[1]) for i, j in ends if low < i <= high]
        assert of_it == (x[0] if x else [(len(made[n][0]), len(made[n][1]))])
        assert not x or links[of == n].tolist() == x[1]


@pytest.mark.parametrize("rows", [0])
def test_empty_table(spark, rows):
    found = A.link_counts(spark.createDataFrame([], "doc_id long, text string"), FILES)
    assert found.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"] and found.count() == rows
