"""Token classification: WordPiece input, where tokens stand in the text, and labels gathered into spans.

A model is anything that turns token ids into a row of scores per token. What surrounds it is plain Python over one text,
run in Arrow batches by operators.recognizing.
"""

from __future__ import annotations

import json
import unicodedata
from bisect import bisect_left
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field
from functools import lru_cache
from pathlib import Path
from typing import NamedTuple

import numpy as np

from palimpsest.functions.entities import TYPE_ID

#: Kinds by a label's core. Fixed values.
LABEL_KINDS = {"PER": "USER_NAME", "PERSON": "USER_NAME", "ORG": "ORGANIZATION", "LOC": "PHYSICAL_ADDRESS", "GPE": "PHYSICAL_ADDRESS", "FAC": "PHYSICAL_ADDRESS", "ADDRESS": "PHYSICAL_ADDRESS"}
#: Marks that join the parts of a name and that tokenizers may drop. Fixed values.
CONNECTORS = frozenset("-'`−·・⁃∙") | {chr(c) for c in range(0x2010, 0x2016)}
DEFAULT_LENGTH = 512

Inferencer = Callable[[list[int], list[int], list[int]], "np.ndarray"]


class UnsupportedTokenizer(ValueError):
    """A tokenizer whose steps are others than BERT's."""


@dataclass(frozen=True)
class TokenizerSpec:
    vocabulary: dict[str, int]
    lower: bool = True
    strip_accents: bool | None = None  # as lower, if not said
    unknown: str = "[UNK]"
    begin: str = "[CLS]"
    end: str = "[SEP]"

    def build(self) -> Callable[[str, int], tuple[list[int], list[str]]]:
        """(text, longest) -> ids and tokens, begin and end included; the end stays when a text is cut."""
        from tokenizers import Tokenizer, models, normalizers, pre_tokenizers

        strip = self.lower if self.strip_accents is None else self.strip_accents
        made = Tokenizer(models.WordPiece(self.vocabulary, unk_token=self.unknown, max_input_chars_per_word=100))
        made.normalizer = normalizers.BertNormalizer(clean_text=True, handle_chinese_chars=True, strip_accents=strip, lowercase=self.lower)
        made.pre_tokenizer = pre_tokenizers.BertPreTokenizer()

        @lru_cache(1 << 16)
        def pieces(word: str) -> list[str]:
            return made.encode(word, add_special_tokens=False).tokens

        def encode(text: str, longest: int) -> tuple[list[int], list[str]]:
            # All steps of the tokenizer leave what stands between two spaces to itself. Words that fill the input are enough.
            tokens: list[str] = []
            for word in text.split(" "):
                tokens += pieces(word) if len(word) < 64 else pieces.__wrapped__(word)
                if 0 < longest <= len(tokens):
                    break
            tokens = [t for t in (self.begin,) if t in self.vocabulary] + tokens
            if longest > 0:
                tokens = tokens[: longest - 1]
            tokens += [t for t in (self.end,) if t in self.vocabulary]
            return [self.vocabulary[t] for t in tokens], tokens

        return encode


class Token(NamedTuple):
    label: str
    score: float
    start: int
    end: int


class Found(NamedTuple):
    kind: str
    start: int
    end: int
    score: float


def _lowered(text: str) -> str:
    """Lower case, one character for each."""
    # Two letters lower to more than one character, or by what is around them.
    return "".join(c.lower()[0] for c in text) if "\u0130" in text or "\u03a3" in text else text.lower()


def _bare(text: str) -> str:
    return unicodedata.normalize("NFC", "".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c) != "Mn"))


def locate(text: str, tokens: Sequence[str]) -> list[tuple[int, int]]:
    """Places of tokens in a text, by character. Each is looked for from where the last one ended, then from the beginning, then
    without accents and connectors; one that is not found is empty and stands where the last one ended."""
    lower, bare = _lowered(text), None

    def find(where: str, what: str, start: int) -> int:
        place = where.find(what, start)
        return place if place >= 0 else where.find(what)

    out, at, bare_at = [], 0, None
    for token in tokens:
        name = _lowered(token.removeprefix("##"))
        if name and (place := find(lower, name, at)) >= 0:
            at, bare_at = place + len(name), None
            out.append((place, at))
            continue
        if name and (short := _bare(name)):
            if bare is None:  # few texts need it
                bare, origin = _unmarked(lower)
            if bare_at is None:
                bare_at = bisect_left(origin, at)
            if (place := find(bare, short, bare_at)) >= 0:
                bare_at = place + len(short)
                at = origin[bare_at] if bare_at < len(origin) else len(text)
                out.append((origin[place], at))
                continue
        out.append((at, at))
    return out


def _unmarked(text: str) -> tuple[str, list[int]]:
    """The text without accents and connectors, and where each of its characters comes from."""
    bare, origin = [], []
    for place, char in enumerate(text):
        for part in char if char.isascii() else unicodedata.normalize("NFD", char):
            if part not in CONNECTORS and (part.isascii() or unicodedata.category(part) != "Mn"):
                bare.append(part)
                origin.append(place)
    return "".join(bare), origin


def best_label(scores: np.ndarray, labels: dict[int, str]) -> tuple[str, float]:
    """The label of the highest score, and its softmax."""
    if not len(scores):
        return "", 0.0
    top = int(np.argmax(scores))
    share = 1 / float(np.exp(np.asarray(scores, np.float64) - float(scores[top])).sum())
    return labels.get(top, f"LABEL_{top}"), float(np.float32(share))


def _labels(scores: Iterable[np.ndarray], labels: dict[int, str], ignored: frozenset[str]) -> Iterable[tuple[int, str, float]]:
    """(place, label, softmax) of rows whose label is not ignored."""
    if isinstance(scores, np.ndarray) and scores.ndim == 2 and scores.shape[1]:
        dropped = [i for i in range(scores.shape[1]) if labels.get(i, f"LABEL_{i}") in ignored]
        places = np.flatnonzero(~np.isin(scores.argmax(axis=1), dropped)).tolist()
    else:
        places, scores = None, list(scores)
    for i in range(len(scores)) if places is None else places:
        label, score = best_label(scores[i], labels)
        if label not in ignored:
            yield i, label, score


def split_label(label: str) -> tuple[str, str]:
    """Core and place: "B" begins, "I" goes on, "" says nothing. S and E are B and I."""
    label = label.strip()
    if label[:2] in ("B-", "S-"):
        return label[2:], "B"
    if label[:2] in ("I-", "E-"):
        return label[2:], "I"
    return label or "MISC", ""


def labelled(text: str, tokens: Sequence[str], scores: Iterable[np.ndarray], labels: dict[int, str], ignored: frozenset[str], renamed: Callable[[list[str]], list[str]] | None = None) -> list[Token]:
    """Tokens with a label that is not ignored, by place in the text; touching ones of one core are joined, their score the mean."""
    own = [i for i, t in enumerate(tokens) if t and not (t.startswith("[") and t.endswith("]"))]
    names = [tokens[i].removeprefix("##") for i in own]
    if renamed:
        names = [new or old for new, old in zip(renamed(names), names, strict=True)]
    places = dict(zip(own, locate(text, names), strict=True))
    out: list[Token] = []
    count = 0
    for i, label, score in _labels(scores, labels, ignored):
        if i not in places:
            continue
        start, end = places[i]
        last = out[-1] if out else None
        core = (lambda x: x[2:] if len(x) > 2 and x[:2] in ("B-", "I-", "E-", "S-") else x)
        if last and core(last.label) == core(label) and last.end == start:
            out[-1] = Token(last.label, (last.score * count + score) / (count + 1), last.start, end)
            count += 1
        else:
            out.append(Token(label, score, start, end))
            count = 1
    return out


def gathered(text: str, tokens: Iterable[Token]) -> list[Found]:
    """Spans from tokens that begin and go on. A label of no kind, another kind or a new beginning ends a span; a span's score is
    the running mean of two. What goes on without a beginning is dropped."""
    out: list[Found] = []
    open_ = False
    for token in tokens:
        core, place = split_label(token.label)
        kind = LABEL_KINDS.get(core.upper())
        if kind is None:
            open_ = False
            continue
        goes_on = open_ and out[-1].kind == kind and (place != "B" or text[token.start : token.end].startswith("##"))
        if goes_on:
            last = out[-1]
            out[-1] = last._replace(end=token.end, score=(last.score + token.score) / 2)
        elif place == "B":
            out.append(Found(kind, token.start, token.end, token.score))
            open_ = True
        else:
            open_ = False
    return out


@dataclass(frozen=True)
class TokenModel:
    """All that a recogniser needs. make_inferencer is called once in each Python worker.

    to_model and to_source convert between scripts: the text before it is tokenised, tokens before they are located.
    """

    name: str
    tokenizer: TokenizerSpec
    labels: dict[int, str]
    make_inferencer: Callable[[], Inferencer]
    longest: int = DEFAULT_LENGTH
    ignored: frozenset[str] = frozenset({"O"})
    to_model: Callable[[str], str] | None = None
    to_source: Callable[[list[str]], list[str]] | None = None

    def start(self) -> Callable[[str, bool], list[Found]]:
        """(text, convert) -> spans by byte offset."""
        encode, infer = self.tokenizer.build(), self.make_inferencer()

        def recognise(text: str, convert: bool = False) -> list[Found]:
            if not text:
                return []
            convert = convert and self.to_model is not None
            ids, tokens = encode(self.to_model(text) if convert else text, self.longest)
            scores = infer(ids, [1] * len(ids), [0] * len(ids))
            renamed = None
            if convert and self.to_source:
                renamed = self._renamed
            found = gathered(text, labelled(text, tokens, scores, self.labels, self.ignored, renamed))
            size = lambda end: len(text[:end].encode())
            return [f._replace(start=size(f.start), end=size(f.end)) for f in found]

        return recognise

    def _renamed(self, tokens: list[str]) -> list[str]:
        out = self.to_source(tokens)
        if len(out) != len(tokens):
            raise ValueError("the converter gave back another number of tokens")
        return out


assert set(LABEL_KINDS.values()) <= set(TYPE_ID)


def read_vocabulary(folder: Path) -> dict[str, int]:
    """vocab.txt, or else the vocabulary in tokenizer.json."""
    plain = folder / "vocab.txt"
    if plain.exists():
        tokens = plain.read_text(encoding="utf-8").split("\n")
        if tokens and not tokens[-1]:
            tokens.pop()
        out = {t.rstrip("\r"): i for i, t in enumerate(tokens)}
    else:
        out = json.loads((folder / "tokenizer.json").read_text(encoding="utf-8")).get("model", {}).get("vocab", {})
    if not out:
        raise ValueError(f"no vocabulary in {folder}")
    return out


def _only(part: dict | None, kind: str, inner: str) -> dict | None:
    """The one step of this kind, by itself or alone in a sequence; other steps are refused."""
    if not part or not part.get("type"):
        return None
    if part["type"] == kind:
        return part
    if part["type"] == "Sequence" and len(part.get(inner) or []) == 1:
        return _only(part[inner][0], kind, inner)
    raise UnsupportedTokenizer(f"{part['type']} instead of {kind}")


def read_tokenizer(folder: Path) -> TokenizerSpec:
    """The tokenizer of a model folder. tokenizer.json counts for more than tokenizer_config.json."""
    config, whole = {}, {}
    if (folder / "tokenizer_config.json").exists():
        config = json.loads((folder / "tokenizer_config.json").read_text(encoding="utf-8"))
    if (folder / "tokenizer.json").exists():
        whole = json.loads((folder / "tokenizer.json").read_text(encoding="utf-8"))
    if config.get("do_basic_tokenize") is False or config.get("tokenize_chinese_chars") is False or config.get("never_split"):
        raise UnsupportedTokenizer("basic and Chinese tokenization must be on, and nothing kept from splitting")
    kind = (whole.get("model") or {}).get("type") or "WordPiece"
    if kind.lower() != "wordpiece":
        raise UnsupportedTokenizer(f"a model of type {kind}")
    _only(whole.get("pre_tokenizer"), "BertPreTokenizer", "pretokenizers")
    lower, strip = config.get("do_lower_case", True), config.get("strip_accents")
    if (step := _only(whole.get("normalizer"), "BertNormalizer", "normalizers")) is not None:
        if step.get("clean_text") is False or step.get("handle_chinese_chars") is False:
            raise UnsupportedTokenizer("texts must be cleaned and Chinese characters split")
        lower, strip = step.get("lowercase", True), step.get("strip_accents")
    names = {field_: config.get(key) for field_, key in (("unknown", "unk_token"), ("begin", "cls_token"), ("end", "sep_token")) if isinstance(config.get(key), str)}
    return TokenizerSpec(read_vocabulary(folder), True if lower is None else bool(lower), strip, **names)


def onnx_inferencer(path: str) -> Inferencer:
    """An inferencer over onnxruntime; inputs are given by name, as far as the model has them."""
    import onnxruntime

    session = onnxruntime.InferenceSession(path, providers=["CPUExecutionProvider"])
    wanted = {i.name for i in session.get_inputs()}

    def infer(ids: list[int], mask: list[int], types: list[int]) -> np.ndarray:
        feed = {"input_ids": ids, "attention_mask": mask, "token_type_ids": types}
        return session.run(None, {k: np.array([v], np.int64) for k, v in feed.items() if k in wanted})[0][0]

    return infer


@dataclass(frozen=True)
class _Onnx:
    path: str = field(default="")

    def __call__(self) -> Inferencer:
        return onnx_inferencer(self.path)


def load_folder(name: str, folder: str, **options) -> TokenModel:
    """A model from its folder: config.json (labels, longest input), tokenizer files and model.onnx or onnx/model.onnx."""
    root = Path(folder)
    config = json.loads((root / "config.json").read_text(encoding="utf-8"))
    labels = {int(k): v for k, v in (config.get("id2label") or {}).items()}
    if not labels:
        raise ValueError(f"no labels in {folder}")
    limits = [config.get("max_position_embeddings")]
    if (root / "tokenizer_config.json").exists():
        limits.append(json.loads((root / "tokenizer_config.json").read_text(encoding="utf-8")).get("model_max_length"))
    limits = [int(x) for x in limits if isinstance(x, int | float) and 0 < x < 1 << 20]
    model = next((p for p in (root / "model.onnx", root / "onnx" / "model.onnx") if p.exists()), None)
    if model is None:
        raise FileNotFoundError(f"no model.onnx in {folder}")
    return TokenModel(name, read_tokenizer(root), labels, _Onnx(str(model)), min(limits, default=DEFAULT_LENGTH), **options)
