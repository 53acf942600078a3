"""Language of a text by its scripts, as one expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsest.functions.spans import bind

#: Characters that only traditional Chinese has, of those in daily use. Fixed values.
TRADITIONAL = "個們這裡與從對開關會學點國時間長車馬鳥魚門東風雲龍區縣灣臺鄉鎮號樓層裝業產經濟財務資訊網絡電腦軟體讀寫發現實際貳參陸萬億謝請問題應該樣單雙歲圖書館銀證來為說話語職員專術機構織師傳統計劃備聽視覺醫療藥廠標準則規範圍繞認識別記憶檔夾複製貼稱碼誌總營運輸達郵遞憑據驗錯誤"
_KANA = r"\p{IsHiragana}\p{IsKatakana}\x{FF66}-\x{FF9D}"


def detect(text: Column) -> Column:
    """zh-Hans, zh-Hant, ja, ko, en or the empty string (nothing to tell by; also for a null text).

    Kana or Hangul decide if they are a quarter of all letters; Chinese characters if they are a tenth of other letters.
    """
    text = F.coalesce(text, F.lit(""))
    # ASCII letters are counted by what is left without them; all other counts need what is not ASCII only.
    rest = F.regexp_replace(text, r"[\x00-\x7F]+", "")
    letters = F.char_length(text) - F.char_length(F.regexp_replace(text, "[A-Za-z]+", ""))

    def counts(rest: Column) -> Column:
        count = lambda pattern: F.regexp_count(rest, F.lit(pattern))
        return F.struct(
            count(f"[{_KANA}]").alias("kana"),
            count(r"\p{IsHangul}").alias("hangul"),
            count(r"\p{IsHan}").alias("han"),
            (letters + count(rf"[\p{{L}}&&[^{_KANA}\p{{IsHangul}}\p{{IsHan}}]]")).alias("other"),
            count(f"[{TRADITIONAL}]").alias("traditional"),
        )

    def decided(c: Column) -> Column:
        total = c["kana"] + c["hangul"] + c["han"] + c["other"]
        return (
            F.when((c["kana"] > 0) & (c["kana"] * 4 >= total), "ja")
            .when((c["hangul"] > 0) & (c["hangul"] * 4 >= total), "ko")
            .when((c["han"] == 0) & (c["other"] == 0), "")
            .when((c["han"] == 0) | (c["han"] * 10 < c["other"]), "en")
            .when(c["traditional"] > 0, "zh-Hant")
            .otherwise("zh-Hans")
        )

    plain = F.when(F.regexp_like(text, F.lit("[A-Za-z]")), "en").otherwise("")
    return F.when(F.octet_length(text) == F.char_length(text), plain).otherwise(bind(bind(rest, counts), decided))


def is_chinese(language: Column) -> Column:
    return F.regexp_like(F.lower(F.coalesce(language, F.lit(""))), F.lit("^zh(?:$|[-_])"))


def language_or_detected(language: Column | None, text: Column) -> Column:
    """The given language; where it is null, empty or auto, the detected one."""
    if language is None:
        return detect(text)
    return F.when(F.coalesce(language, F.lit("")).isin("", "auto"), detect(text)).otherwise(language)
