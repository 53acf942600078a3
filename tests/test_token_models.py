"""Token classification with scores made up by token."""

import json

import numpy as np
import pytest

from palimpsest.functions.entities import Switches
from palimpsest.functions.token_models import Found, Token, TokenizerSpec, TokenModel, UnsupportedTokenizer, best_label, gathered, load_folder, locate, read_tokenizer, split_label
from palimpsest.operators.masking import Options, mask_frame
from palimpsest.operators.recognizing import load_or_none, not_chinese, recognizer, routed

VOCABULARY = ["[PAD]", "[UNK]", "[CLS]", "[SEP]", "john", "doe", "acme", "corp", "##oration", "works", "at", "北", "京", "市", "朝", "阳", "区", "."]
LABELS = dict(enumerate(["O", "B-PER", "I-PER", "B-ORG", "I-ORG", "B-LOC", "I-LOC", "B-MISC"]))
SPEC = TokenizerSpec({t: i for i, t in enumerate(VOCABULARY)})


class Made:
    def __init__(self, **labels):
        self.rows = {VOCABULARY.index(t): n for t, n in labels.items()}

    def __call__(self):
        def infer(ids, mask, types):
            out = np.full((len(ids), len(LABELS)), -5.0, np.float32)
            for i, token in enumerate(ids):
                out[i, self.rows.get(token, 0)] = 5
            return out

        return infer


def model(**labels):
    return TokenModel(f"t{sorted(labels.items())}", SPEC, LABELS, Made(**labels))


def test_tokens():
    encode = SPEC.build()
    assert encode("Acme Corporation.", 0)[1] == ["[CLS]", "acme", "corp", "##oration", ".", "[SEP]"]
    assert encode("北京 zzzz", 0)[1] == ["[CLS]", "北", "京", "[UNK]", "[SEP]"]
    assert encode("北京市朝阳区", 4)[1] == ["[CLS]", "北", "京", "[SEP]"]
    assert encode("x" * 101, 0)[1] == ["[CLS]", "[UNK]", "[SEP]"]


@pytest.mark.parametrize(
    ("text", "tokens", "want"),
    [
        ("Acme Corporation is here", ["acme", "corp", "##oration", "is"], ["Acme", "Corp", "oration", "is"]),
        ("José lives here", ["jose", "lives"], ["José", "lives"]),
        ("O'Brien called", ["obrien", "called"], ["O'Brien", "called"]),
        ("北京市", ["北", "京", "市"], ["北", "京", "市"]),
        ("hello world", ["hello", "zzzz", "world", ""], ["hello", "", "world", ""]),
        ("K and john", ["john"], ["john"]),
        ("b a", ["a", "b"], ["a", "b"]),
    ],
)
def test_places(text, tokens, want):
    assert [text[s:e] for s, e in locate(text, tokens)] == want


def test_labels():
    assert [split_label(x) for x in ("B-PER", "S-ORG", "I-LOC", "E-LOC", "MISC", "")] == [("PER", "B"), ("ORG", "B"), ("LOC", "I"), ("LOC", "I"), ("MISC", ""), ("MISC", "")]
    label, score = best_label(np.array([0.0, 9.0], np.float32), {})
    assert label == "LABEL_1" and 0.99 < score < 1


def test_gathering():
    text = "John A. Doe works here"
    run = [Token("B-PER", 0.9, 0, 4), Token("I-PER", 0.8, 5, 7), Token("E-PER", 0.7, 8, 11), Token("MISC", 0.9, 12, 17), Token("I-PER", 0.9, 18, 22)]
    assert [(f.kind, f.start, f.end, round(f.score, 3)) for f in gathered(text, run)] == [("USER_NAME", 0, 11, 0.775)]
    assert [f[:3] for f in gathered("John Mary", [Token("B-PER", 0.9, 0, 4), Token("B-PER", 0.9, 5, 9)])] == [("USER_NAME", 0, 4), ("USER_NAME", 5, 9)]
    assert [f[:3] for f in gathered("John Acme", [Token("B-PER", 0.9, 0, 4), Token("I-ORG", 0.9, 5, 9)])] == [("USER_NAME", 0, 4)]
    assert gathered("John", [Token("I-PER", 0.9, 0, 4)]) == []
    # what is ignored between leaves no trace: the span goes on across it
    assert gathered("a b c", [Token("B-PER", 1.0, 0, 1), Token("I-PER", 1.0, 4, 5)]) == [Found("USER_NAME", 0, 5, 1.0)]


def test_recognition():
    found = model(john=1, doe=2, acme=3, corp=4, **{"##oration": 4}).start()("John Doe works at Acme Corporation")
    assert [f[:3] for f in found] == [("USER_NAME", 0, 8), ("ORGANIZATION", 18, 34)]
    place = model(北=5, 京=6, 市=6, 朝=6, 阳=6, 区=6).start()("在北京市朝阳区")
    assert [f[:3] for f in place] == [("PHYSICAL_ADDRESS", 3, 21)]
    assert model().start()("") == []


def test_conversion():
    whole = TokenModel("c", SPEC, LABELS, Made(北=5), to_model=lambda t: t.replace("B", "北"), to_source=lambda ts: ["B" if t == "北" else t for t in ts])
    assert [f[:3] for f in whole.start()("éB", True)] == [("PHYSICAL_ADDRESS", 2, 3)]
    assert whole.start()("éB", False) == []


def test_masking_with_models(spark):
    options = Options(recognizers=routed(model(john=1, doe=2), model(北=5, 京=6, 市=6, 朝=6, 阳=6, 区=6)), addresses=True, switches=Switches.all())
    df = spark.createDataFrame([(1, "John Doe, a@b.cd", None), (2, "住在北京市朝阳区建国路88号。", None), (3, "John Doe", "zh-Hans"), (4, None, None), (5, "北京市朝阳区 ok", None)], "i int, text string, language string")
    got = {r.i: r.masked for r in mask_frame(df, options=options, language_col="language").collect()}
    assert got == {1: "__PII_USER_NAME_1__, __PII_EMAIL_ADDRESS_2__", 2: "住在__PII_PHYSICAL_ADDRESS_1__。", 3: "John Doe", 4: None, 5: "北京市朝阳区 ok"}
    assert recognizer(model(john=1), not_chinese)


def test_a_failing_model_fails_the_batch(spark):
    def broken():
        raise RuntimeError("no model")

    df = spark.createDataFrame([("x",)], "text string")
    with pytest.raises(Exception, match="no model"):
        mask_frame(df, options=Options(recognizers=(recognizer(TokenModel("broken", SPEC, LABELS, broken)),))).collect()


def test_folders(tmp_path):
    assert load_or_none("x", str(tmp_path / "none")) is None and load_or_none("x", None) is None
    (tmp_path / "vocab.txt").write_text("\n".join(VOCABULARY) + "\n")
    (tmp_path / "config.json").write_text(json.dumps({"id2label": {"0": "O", "1": "B-PER"}, "max_position_embeddings": 128}))
    (tmp_path / "tokenizer_config.json").write_text(json.dumps({"do_lower_case": False, "model_max_length": 10**30}))
    (tmp_path / "model.onnx").write_bytes(b"")
    made = load_folder("x", str(tmp_path))
    assert made.longest == 128 and made.labels == {0: "O", 1: "B-PER"} and not made.tokenizer.lower and made.tokenizer.vocabulary["john"] == 4
    for whole in ({"model": {"type": "BPE"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "BertNormalizer"}]}}, {"normalizer": {"type": "BertNormalizer", "clean_text": False}}):
        (tmp_path / "tokenizer.json").write_text(json.dumps(whole))
        with pytest.raises(UnsupportedTokenizer):
            read_tokenizer(tmp_path)
    (tmp_path / "tokenizer.json").write_text(json.dumps({"normalizer": {"type": "Sequence", "normalizers": [{"type": "BertNormalizer", "lowercase": True}]}, "pre_tokenizer": {"type": "BertPreTokenizer"}}))
    assert read_tokenizer(tmp_path).lower


def test_only_what_fills_the_input_is_encoded(monkeypatch):
    """Long texts give the same tokens, though all that follows the longest input is left alone; labels are told a table at a time."""
    import tokenizers

    from palimpsest.functions import token_models

    seen, real = [], tokenizers.Tokenizer

    class Spy:
        def __init__(self, *a):
            object.__setattr__(self, "made", real(*a))

        def __setattr__(self, name, value):
            setattr(self.made, name, value)

        def encode(self, text, **how):
            seen.append(len(text))
            return self.made.encode(text, **how)

    monkeypatch.setattr(tokenizers, "Tokenizer", Spy)
    words = {t: i for i, t in enumerate(["[UNK]", "[CLS]", "[SEP]", "mary", "o", "##slo"])}
    encode = TokenizerSpec(words).build()
    for text in ("mary oslo " * 5000, "\x01 " * 300 + "mary " * 2000, "x" * 3000 + " mary" * 50, "Mary", ""):
        whole = encode(text, 0)[1]
        assert encode(text, 32)[1] == (whole if len(whole) <= 32 else whole[:31] + ["[SEP]"])
    seen.clear()
    encode("mary oslo " * 5000, 32)
    assert max(seen) < 500
    told = []
    monkeypatch.setattr(token_models, "best_label", lambda *a: told.append(1) or best_label(*a))
    scores = np.zeros((40, 2), np.float32)
    scores[:, 0], scores[3] = 1, (0, 9)
    found = token_models.labelled("mary " * 40, ["mary"] * 40, scores, {0: "O", 1: "B-PER"}, frozenset({"O"}))
    assert [(t.label, t.start) for t in found] == [("B-PER", 15)] and len(told) == 1
