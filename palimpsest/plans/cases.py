"""Inline cases that the registered queries run beside the tables, since those hold no such text, and what must come of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from palimpsest.functions.token_models import TokenizerSpec, TokenModel

_KEY = "-----BEGIN EC PRIVATE KEY-----\nMHcCAQEE\nIBkg\n-----END EC PRIVATE KEY-----"
_SEED = "tiger lamp ocean velvet rocket maple tunnel gravy helmet onion zebra quartz"
#: Text, and the text after masking. Ids fall from -101.
MASKED = [
    ("write to ann.lee+x@mail.example.org, or to bo@x.io!", "write to __PII_EMAIL_ADDRESS_1__, or to __PII_EMAIL_ADDRESS_2__!"),
    ("ring +44 20 7946 0018 soon", "ring __PII_PHONE_NUMBER_1__ soon"),
    ("1357 2468", "__PII_PHONE_NUMBER_1__"),
    ("1357 or 2468", "__PII_VERIFICATION_CODE_1__ or __PII_VERIFICATION_CODE_2__"),
    ("card 5555444433332222 end", "card __PII_PHONE_NUMBER_1__ end"),
    ("Your 2FA code: Q7W8E9R0 expires", "Your 2FA code: __PII_VERIFICATION_CODE_1__ expires"),
    ("otp ZYXWVUTSRQPO, otp: 98765", "otp __PII_VERIFICATION_CODE_1__, otp: __PII_VERIFICATION_CODE_2__"),
    ("my password: swordfish", "my password: swordfish"),
    ("login pwd = tr0ub4dor&3 today", "login pwd = __PII_PASSWORD_1__ today"),
    ("passcode: hush tail", "passcode: __PII_PASSWORD_1__ tail"),
    (f"key {_KEY} end", "key __PII_PRIVATE_KEY_1__ end"),
    ("raw " + "9f" * 32 + " end", "raw __PII_PRIVATE_KEY_1__ end"),
    (f"Mnemonic = {_SEED}", "__PII_RANDOM_SEED_1__"),
    ("read https://docs.example.net/a?b=c#d now", "read __PII_URL_ADDRESS_1__ now"),
    ("中心B座1503室", "中心B座1503室"),
    ("９８７６５４３２１０", "__PII_PHONE_NUMBER_1__"),
    ("\U0001f600é 4321 x", "\U0001f600é __PII_VERIFICATION_CODE_1__ x"),
    ("nothing here", "nothing here"),
    ("", ""),
]
#: Text and its language. Ids fall from -201.
LANGUAGES = [
    ("A plain sentence.", "en"),
    ("une phrase très simple", "en"),
    ("Простое предложение", "en"),
    ("2024-05-06", ""),
    ("今日は天気がいいですね", "ja"),
    ("ｶﾀｶﾅ", "ja"),
    ("오늘은 날씨가 좋다", "ko"),
    ("我们在公园里散步", "zh-Hans"),
    ("我們在公園裡散步", "zh-Hant"),
    ("请把备注の写清楚一些，谢谢大家", "zh-Hans"),
    ("one 字 among many Latin letters", "en"),
]
#: Reply, original, items (id, type_id, start, end) and what is restored. Ids fall from -301.
RESTORED = [
    ("to __PII_EMAIL_ADDRESS_1__, from __PII_PHONE_NUMBER_2__", "x@y.zz 5550100", [(1, 2, 0, 6), (2, 5, 7, 14)], "to x@y.zz, from 5550100"),
    ("__PII_PHONE_NUMBER_2__ before __PII_EMAIL_ADDRESS_1__", "x@y.zz 5550100", [(1, 2, 0, 6), (2, 5, 7, 14)], "5550100 before x@y.zz"),
    ("__PII_EMAIL_ADDRESS_1__ and __PII_EMAIL_ADDRESS_1__", "x@y.zz", [(1, 2, 0, 6)], "x@y.zz and __PII_EMAIL_ADDRESS_1__"),
    ("__PII_EMAIL_ADDRESS_7__ __PII_PHONE_NUMBER_1__", "x@y.zz", [(1, 2, 0, 6)], "__PII_EMAIL_ADDRESS_7__ __PII_PHONE_NUMBER_1__"),
    ("__PII_EMAIL_ADDRESS_1__", "x@y", [(1, 2, 0, 6)], "__PII_EMAIL_ADDRESS_1__"),
    ("left as it is", "x@y.zz", [], "left as it is"),
]
#: Texts that hold placeholders before they are masked. Ids fall from -701.
PLACEHOLDERS = ["see __PII_EMAIL_ADDRESS_3__ or a@b.cd", "__PII_PHONE_NUMBER_1____PII_PHONE_NUMBER_2__ and __PII_OTHER__", "otp: 55512, then __PII_USER_NAME_12__"]
#: A value masked in the first text of each pair and left alone in the second. Ids fall from -601, -602 for each pair.
LEAKS = [
    ("the pwd: quagmire77 is new", "she said quagmire77 aloud"),
    ("otp ZEBRA9X, hurry", "ZEBRA9X, not ZEBRA9XY"),
    ("passcode: w\\E(r0ng", "w\\E(r0ng"),
    ("pass = lonely88", "nolonely88 lonely888"),
]
#: Whole lines taken for pieces of an address: text, then score, start and end of what is fused. Fixed values.
ADDRESSES = [
    ("北京市朝阳区建国路 88 号", [(0.9874, 0, 34)]),
    ("珠海市香洲路明月花园12栋508房", [(0.9974, 0, 41)]),
    ("上海市浦东新区", []),
    ("成都市高新区天府大道100号环球中心5楼", [(0.9949, 0, 52)]),
    ("香港中環皇后大道中99號中環中心18樓1803室", [(0.9974, 0, 56)]),
    ("臺北市信義區松壽路11號台北101大樓18樓", [(0.9949, 0, 52)]),
    ("台中市西屯區文心路二段123號", [(0.9874, 0, 39)]),
    ("苏州市工业园区星海街星海广场2栋18层1802室", [(0.9974, 0, 58)]),
]
#: Text and its (type, start, end) by the small model below, whose names are single words.
TOKENS = [
    ("Mary Jones joined Globex Industries in Oslo", [("USER_NAME", 0, 10), ("ORGANIZATION", 18, 35), ("PHYSICAL_ADDRESS", 39, 43)]),
    ("Jones alone begins nothing", []),
    ("Mary Mary", [("USER_NAME", 0, 4), ("USER_NAME", 5, 9)]),
    ("José, then Mary", [("USER_NAME", 0, 5), ("USER_NAME", 12, 16)]),
    ("nobody", []),
    ("", []),
]
_WORDS = {"mary": "B-PER", "jose": "B-PER", "jones": "I-PER", "globex": "B-ORG", "indus": "I-ORG", "##tries": "I-ORG", "oslo": "B-LOC"}
_LABELS = dict(enumerate(["O", *dict.fromkeys(_WORDS.values())]))
_VOCABULARY = {t: i for i, t in enumerate(["[PAD]", "[UNK]", "[CLS]", "[SEP]", "joined", "in", "then", ",", *_WORDS])}


def _scores():
    """Certain labels by token, in place of a trained model's."""
    import numpy as np

    number = {label: i for i, label in _LABELS.items()}
    labels = {_VOCABULARY[t]: number[label] for t, label in _WORDS.items()}

    def infer(ids, mask, types):
        out = np.full((len(ids), len(_LABELS)), -6.0, np.float32)
        out[np.arange(len(ids)), [labels.get(int(i), 0) for i in ids]] = 6.0
        return out

    return infer


WORD_MODEL = TokenModel("words", TokenizerSpec(_VOCABULARY), _LABELS, _scores)


def rows(spark: SparkSession, first: int, texts: list[str], names: str = "doc_id long, text string") -> DataFrame:
    """(id, text) with ids that fall from `first`."""
    return spark.createDataFrame([(first - i, t) for i, t in enumerate(texts)], names)


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def values(first: int, texts: list[str]) -> str:
    """The same rows in SQL."""
    return ", ".join(f"({first - i}, {quoted(t)})" for i, t in enumerate(texts))
