"""Risk rules over a cue's source and translated text as Columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import FRAGMENT_END, HANGUL, bounded, characters_per_minute, has_repeated_clause, lowered, strip_marks, trimmed, visible_length

# fixed values: words and patterns of the rules
RESIDUE_WORDS = (
    "a an and are as at be because but by can do for from have he her his i if in is it me my no not of on or our she that the their "
    "this to was we what when where will with you your"
).split()
LATIN_TOKENS = "AI AOE ATK BGM BOSS CD CPU DEF DMG DPS ER EXP FPS GPU HP NPC OST PC PVP SFX UI UID URL VPN".split()
CREDITS = r"(?i)\b(?:subtitles?|subs|subbing|captioning|captions|transcription|transcribed|translation)\s+by\b|\bcastingwords\b|\brev\.com\b|\bamara\.org\b|\bopensubtitles\b|\bsubscene\b"
NOISE = (
    r"(?i)[\[\(\{]\s*(?:beep\w*|bleep\w*|inaudible\w*|unintelligible\w*|muffled|crosstalk|static|noise|click\w*|alarm|siren|laughter|laughing|chuckl\w+"
    r"|sighs?|gasps?|cough\w+|whisper\w+|groan\w+|screaming|speaking\s+(?:a\s+)?foreign\s+language|foreign\s+language)\b[^\]\)\}]{0,24}[\]\)\}]|\bignore\s+(?:the\s+)?noise\b"
)
KANA_RESIDUE = r"[\x{3040}-\x{30FF}]"
HAN_BASIC = r"[\x{3400}-\x{9FFF}]"
TARGET_FRAGMENT = "(?:一个|一种|这个|那个|还挺|非常|有点|是个|为了|因为|如果|关于|作为|或者|以及|并且|但是|不过|而且|或|和|跟|但|对|在|从|向|把|被|给|比|很|第|的)$"
SOURCE_FRAGMENT_JA, TARGET_FRAGMENT_JA = r"(?:の|と|に|て|が|を|は|も|から|なの)\s*$", "(?:的|和|与|在|对|把|让|如果|因为|为了)$"
#: By language: pattern of a negation and of a condition in the source, and what stands for each in the target.
MARKERS = {
    "ja": ("(?:ない|なく|ぬ|ません|無し|不|非)", "(?:もし|なら|ば|たら|なければ|除いて|場合)", "不 没 无 非 别 未 莫 休想", "如果 要是 除非 只要 一旦 的话 是否 能不能 会不会"),
    "ko": (r"(?:^|\s)(?:안|못)(?:\s|$)|지\s*않|는\s*건\s*아니|절대.{0,8}않|없", r"(?:면|다면|거든|니까|지만|는데)(?:\s|[,，.]|$)", "不 没 无 非 别 未 绝不 不会 不能", "如果 要是 只要 因为 所以 但是 不过 的话"),
    "en": (r"\b(?:no|not|never|without|neither|nor)\b", r"\b(?:if|unless|whether)\b", "不 没 未 无 别 并非 绝非 从不 绝不 免 缺 少 零 休想 不曾", "如果 若 要是 除非 只要 是否 的话 能不能 会不会 到底 取决于"),
}
NOT_NEGATION, NOT_CONDITION = r"\b(?:no wonder|no doubt|not only)\b", r"\bas if\b"
ASKS_EITHER = r"([\x{3400}-\x{9FFF}])不\1"
FORGOT = r"\b(?:don'?t|do not|can'?t|cannot)\b.{0,28}\b(?:remember|recall)\b|\bforgot(?:ten)?\b"
FORGOTTEN_NAME = r"^[A-Z][A-Za-z]{2,}(?:\s+something)?\b"
AUTOMATIC = (
    "empty_translation number_mismatch term_mismatch english_residue kana_residue hangul_residue negation_missing suspected_name incomplete_fragment "
    "semantic_marker_missing unknown_entity hallucinated_entity source_unresolved text_conflict repeated_clause low_info_density"
).split()
MANUAL = "person_name_present contextual_entity_preserved contextual_entity_unverified".split()
ADVISORY = "reading_speed condition_marker_missing credit_line noise_command".split()
CONFLICT = "text_conflict source_unresolved".split()
TRUSTED_NAMES = "unknown_entity person_name_present contextual_entity_preserved contextual_entity_unverified".split()
SCORES = {
    "text_conflict": 3, "empty_translation": 10, "credit_line": 3, "noise_command": 2, "repeated_clause": 4, "number_mismatch": 5, "english_residue": 3, "kana_residue": 4,
    "hangul_residue": 4, "person_name_present": 3, "term_mismatch": 5, "suspected_name": 5, "reading_speed": 2, "low_info_density": 2, "negation_missing": 6,
    "condition_marker_missing": 2, "incomplete_fragment": 7,
}


def strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def word_runs(text: Column) -> Column:
    """Runs of letters, digits and underscores."""
    return F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def number_set(text: Column) -> Column:
    """Distinct numbers, ascending, without their separators."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"\d+(?:[.,]\d+)?"), F.lit(0)), lambda v: F.regexp_replace(v, "[.,]", ""))))


def has_english_residue(text: Column) -> Column:
    """Latin words that a translation left: known function words, and beside Han any word that isn't a usual abbreviation."""
    found = F.filter(word_runs(text), lambda w: w.rlike("^[A-Za-z]{2,}$") & ~F.upper(w).isin(LATIN_TOKENS))
    return F.exists(found, lambda w: w.isin(RESIDUE_WORDS)) | ((F.size(found) > 0) & text.rlike(HAN_BASIC))


def has_kana_residue(text: Column) -> Column:
    return text.rlike(KANA_RESIDUE)


def has_hangul_residue(text: Column) -> Column:
    return text.rlike(HANGUL)


def has_credit_line(text: Column) -> Column:
    return text.rlike(bounded(CREDITS))


def has_noise_command(text: Column) -> Column:
    return text.rlike(bounded(NOISE))


def is_incomplete(source: Column, target: Column, language: str = "en") -> Column:
    """Source and target both stop on a word that asks for more."""
    said = strip_marks(source)
    if language == "ja":
        return said.rlike(SOURCE_FRAGMENT_JA) & F.trim(target).rlike(TARGET_FRAGMENT_JA)
    return said.rlike(bounded(FRAGMENT_END)) & F.regexp_replace(trimmed(target), r"[，,、；;：:]+\z", "").rlike(bounded(TARGET_FRAGMENT))


def suspects_forgotten_name(source: Column) -> Column:
    """A name after a speaker mark where the speaker says that they forgot one."""
    after = trimmed(F.regexp_extract(source, r"(?s)^.*?>>(.*)$", 1))
    return source.contains(">>") & lowered(source).rlike(bounded(FORGOT)) & after.rlike(bounded(FORGOTTEN_NAME))


def missing_markers(source: Column, target: Column, language: str = "en") -> tuple[Column, Column]:
    """Whether a negation, and whether a condition, of the source has nothing in the target that stands for it."""
    negation, condition, no, if_ = MARKERS[language]
    has = lambda words: reduce(lambda a, b: a | b, [target.contains(w) for w in words.split()])
    if language != "en":
        return source.rlike(negation) & ~has(no), source.rlike(condition) & ~has(if_)
    low = lowered(source)
    denies = F.regexp_replace(low, bounded(NOT_NEGATION), "").rlike(bounded(negation))
    depends = F.regexp_replace(low, bounded(NOT_CONDITION), "").rlike(bounded(condition))
    return denies & ~has(no), depends & ~has(if_) & ~target.rlike(ASKS_EITHER)


def reads_too_fast(target: Column, duration_ms: Column) -> Column:
    seen = visible_length(target)
    return (duration_ms > 0) & (seen >= 18) & (seen / (duration_ms / 1000) > 14)


def says_too_little(source: Column, duration_ms: Column, floor: Column) -> Column:
    """A long cue with almost no text, far below its track's usual density."""
    return (duration_ms >= 6000) & visible_length(source).between(1, 3) & (characters_per_minute(source, duration_ms) < floor)


def reasons(source: Column, target: Column, duration_ms: Column, floor: Column, *, language: str = "en", conflict: Column, terms_missed: Column, has_terms: Column, names_person: Column) -> Column:
    """Names of the rules that fire, ascending."""
    negation, condition = missing_markers(source, target, language)
    said, got = number_set(source), number_set(target)
    fired = {
        "text_conflict": conflict, "empty_translation": trimmed(target) == "", "credit_line": has_credit_line(source), "noise_command": has_noise_command(source),
        "repeated_clause": has_repeated_clause(source), "number_mismatch": (F.size(said) > 0) & (F.size(got) > 0) & (said != got),
        "english_residue": has_english_residue(target) if language == "en" else F.lit(False), "kana_residue": has_kana_residue(target) if language == "ja" else F.lit(False),
        "hangul_residue": has_hangul_residue(target) if language == "ko" else F.lit(False), "person_name_present": names_person, "term_mismatch": terms_missed,
        "suspected_name": ~has_terms & suspects_forgotten_name(source), "reading_speed": reads_too_fast(target, duration_ms),
        "low_info_density": says_too_little(source, duration_ms, floor), "negation_missing": negation, "condition_marker_missing": condition,
        "incomplete_fragment": is_incomplete(source, target, language),
    }
    return F.array_compact(F.array(*[F.when(fired[name], F.lit(name)) for name in sorted(fired)]))


def score(found: Column) -> Column:
    return reduce(lambda a, b: a + b, [F.when(F.array_contains(found, name), points).otherwise(0) for name, points in SCORES.items()])


def review_required(found: Column) -> Column:
    return F.arrays_overlap(found, strings(AUTOMATIC + MANUAL))


def severity(found: Column) -> Column:
    return F.when(~review_required(found), "advisory").when(score(found) >= 6, "high").otherwise("medium")


def needs_audio(found: Column, flags: Column) -> Column:
    conflict = F.array_contains(flags, "text_conflict")
    return conflict | (F.array_contains(found, "empty_translation") & (F.size(flags) > 0)) | (F.array_contains(found, "incomplete_fragment") & F.arrays_overlap(flags, strings(["whisper_missing", "secondary_missing"])))


def surface(text: Column) -> Column:
    """Lower case, with single spaces for all but Latin letters, digits and Han."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^0-9a-z\x{4E00}-\x{9FFF}]+", " "))


def reason_kinds(found: Column) -> Column:
    """The kinds of reasons of the form kind or kind:payload,payload, ascending."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(found, lambda r: F.trim(F.substring_index(r, ":", 1))), lambda k: k != "")))


def reason_surfaces(found: Column, kind: str) -> Column:
    """Payloads of the last reason of a kind that has any."""
    lists = F.transform(F.filter(found, lambda r: (F.trim(F.substring_index(r, ":", 1)) == kind) & r.contains(":")), lambda r: F.filter(F.transform(F.split(F.regexp_replace(r, "^[^:]*:", ""), ","), lambda p: F.trim(p)), lambda p: p != ""))
    return F.coalesce(F.element_at(F.filter(lists, lambda x: F.size(x) > 0), -1), F.array().cast("array<string>"))


def is_whitelisted(value: Column, entities: list[str], words: list[str]) -> Column:
    """A known brand, a word that is flagged by mistake or several of those, or a longer span that holds a brand of several words."""
    norm = surface(value)
    spans = [F.concat(F.lit(" "), norm, F.lit(" ")).contains(f" {e} ") for e in entities if " " in e] or [F.lit(False)]
    return (norm != "") & (norm.isin(words + entities) | F.forall(F.split(norm, " "), lambda w: w.isin(words)) | reduce(lambda a, b: a | b, spans))


def triage(found: Column, required: Column, language: Column, primary: Column, decision: Column, confidence: Column, entities: list[str], words: list[str], scope: str = "names", least: float = 0.85) -> Column:
    """Why a generated risk may leave the human queue; null where it may not."""
    kinds = reason_kinds(found)
    extra = F.array_except(kinds, strings(ADVISORY))
    within = lambda names: F.size(F.array_except(extra, strings(names))) == 0
    kept = F.lower(F.trim(F.coalesce(decision, F.lit("")))).eqNullSafe("keep") & (F.coalesce(confidence, F.lit(0.0)) >= least)
    flagged = reason_surfaces(found, "unknown_entity")
    verdict = F.when(~F.coalesce(required, F.lit(False)) | (F.size(kinds) == 0), None).when(F.size(extra) == 0, "advisory_only")
    if scope == "all":
        verdict = verdict.when(kept, "trusted_keep")
    elif scope != "off":
        verdict = verdict.when(kept & within(TRUSTED_NAMES + CONFLICT), "trusted_keep_name")
    only_unknown = within(["unknown_entity"]) & (F.size(flagged) > 0) & F.forall(flagged, lambda s: is_whitelisted(s, entities, words))
    return verdict.when(within(CONFLICT), F.when((F.lower(language) == "en") & (F.trim(F.coalesce(primary, F.lit(""))) != ""), "source_conflict_en")).when(only_unknown, "whitelisted_entity")
