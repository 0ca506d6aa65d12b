"""Text expressions. All are columns; nothing here leaves the JVM but `nfc` and `transliterate`."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Words that say nothing about a topic, and words that describe no symptom.
STOP_WORDS = (
    "the", "a", "an", "and", "or", "of", "to", "in", "on", "for", "with", "is", "are", "was", "be", "by", "at", "from", "that", "this", "as", "it", "its",
    "use", "using", "used", "only", "also", "can", "may", "when", "which", "into",
)
SYMPTOM_STOP_WORDS = (
    "with", "and", "the", "are", "from", "that", "this", "for", "appears", "appear", "which", "have", "has", "been", "over", "under", "near", "also", "very", "much",
    "getting", "becoming", "showing", "found", "seen", "there", "they", "some", "into", "onto", "out", "along",
)

# Contact details and identifiers, and what stands in their place.
PHONE = r"(?<!\d)(?:\+?91[\s-]?)?[6-9]\d{9}(?!\d)"
EMAIL = r"[\w.+-]+@[\w-]+\.[\w.-]+"
AADHAAR = r"(?<!\d)\d{4}\s?\d{4}\s?\d{4}(?!\d)"
PAN = r"\b[A-Z]{5}\d{4}[A-Z]\b"
REDACTION = "[redacted]"
#: The classes of these patterns are Unicode's.
PII = {"aadhaar": f"(?U){AADHAAR}", "pan": f"(?U){PAN}", "phone": f"(?U){PHONE}", "email": f"(?U){EMAIL}"}
CONTACTS, IDENTIFIERS = ("phone", "email"), ("aadhaar", "pan")

# Scripts, their Unicode blocks and their languages; the first block that occurs decides.
SCRIPTS = (
    ("gurmukhi", "\u0a00-\u0a7f", ("pa",)), ("gujarati", "\u0a80-\u0aff", ("gu",)), ("oriya", "\u0b00-\u0b7f", ("od",)), ("tamil", "\u0b80-\u0bff", ("ta",)), ("telugu", "\u0c00-\u0c7f", ("te",)),
    ("kannada", "\u0c80-\u0cff", ("kn",)), ("malayalam", "\u0d00-\u0d7f", ("ml",)), ("bengali", "\u0980-\u09ff", ("bn", "as")), ("devanagari", "\u0900-\u097f", ("hi", "mr")),
)

# Words that tell Hindi and Marathi apart, and places where Marathi is likelier.
HINDI_WORDS = (
    "है", "हैं", "की", "को", "में", "से", "और", "यह", "वह", "क्या", "कैसे", "क्यों", "लिए", "गया", "हुआ", "रहा", "था", "थी", "थे", "नहीं", "हम", "आप",
    "मेरा", "हमारा", "पत्तियों", "पत्तियाँ", "फसल", "खेत", "किसान", "बीज", "उर्वरक", "दवा", "छिड़काव", "सिंचाई", "उपज", "मिट्टी", "गोबर", "गेहूं",
    "धान", "मक्का", "गन्ना", "आम", "केला", "प्याज", "टमाटर", "आलू", "मिर्च",
)
MARATHI_WORDS = (
    "आहे", "आहेत", "आहेस", "च्या", "चे", "ची", "मध्ये", "आणि", "हे", "ते", "कसे", "साठी", "गेले", "झाले", "होते", "नाही", "आम्ही", "तुम्ही", "माझे",
    "आमचे", "पाने", "पानांवर", "पीक", "शेत", "शेतकरी", "बियाणे", "खत", "किडा", "औषध", "फवारणी", "सिंचन", "उत्पादन", "माती", "शेण", "गहू", "भात", "मका",
    "ऊस", "आंबा", "केळी", "कांदा", "टोमॅटो", "बटाटा", "मिरची",
)
MARATHI_PLACES = ("IN-MH", "Maharashtra", "mr", "Marathi")


def normalise(x: Column, gap: str = " ") -> Column:
    """Lower case; runs of anything but Unicode letters, digits and _ become one gap; trimmed."""
    return F.trim(F.regexp_replace(F.lower(x), r"(?U)[^\w]+", gap))


def slug(x: Column) -> Column:
    """Runs of other signs than letters, digits, dot, dash and _ become _; `resource` if nothing is left."""
    cut = F.lower(F.regexp_replace(F.regexp_replace(x, r"[^a-zA-Z0-9._-]+", "_"), r"^_+|_+$", ""))
    return F.when(F.coalesce(cut, F.lit("")) == "", "resource").otherwise(cut)


def tokens(x: Column, longer_than: int = 2, stop: tuple[str, ...] = STOP_WORDS) -> Column:
    """ASCII words of more than so many letters that aren't stop words, in their order."""
    return F.filter(F.split(F.lower(x), "[^a-z0-9]+"), lambda t: (F.length(t) > longer_than) & ~t.isin(*stop))


def ngrams(items: Column, n: int, gap: str = " ") -> Column:
    """Runs of n items joined by a gap. Shifted copies are zipped, since what a lambda refers to is computed for each element."""
    size = F.size(items)
    out = items
    for k in range(1, n):
        shifted = F.slice(items, k + 1, F.greatest(size - k, F.lit(0)))
        out = F.zip_with(F.slice(out, 1, F.greatest(size - k, F.lit(0))), shifted, lambda a, b: F.concat(a, F.lit(gap), b))
    return out


def bigrams(words: Column) -> Column:
    return ngrams(words, 2)


def stem(t: Column) -> Column:
    """Light English stemming; the first rule that fits, each with a least length."""
    t = F.lower(t)
    n = F.length(t)
    cut = lambda k: F.substring(t, F.lit(1), n - k)
    return (
        F.when(t.endswith("ves") & (n > 4), F.concat(cut(3), F.lit("f")))
        .when(t.endswith("ies") & (n > 4), F.concat(cut(3), F.lit("y")))
        .when(t.endswith("es") & (n > 3), cut(2))
        .when(t.endswith("ing") & (n > 4), cut(3))
        .when(t.endswith("s") & (n > 3) & ~t.endswith("ss"), cut(1))
        .otherwise(t)
    )


def symptom_text(x: Column) -> Column:
    """Lower case, other signs than a-z, 0-9 and the space as single spaces for each run of them."""
    return F.regexp_replace(F.lower(x), "[^a-z0-9 ]+", " ")


def symptom_tokens(x: Column, lexicon: dict[str, dict[str, str]] | None = None) -> Column:
    """Words that a lexicon (language -> word in another script -> English) has for the text's scripts, then words of three letters
    or more that aren't stop words, then pairs of neighbours among these; each once, in this order."""
    words = F.filter(F.split(symptom_text(x), " "), lambda t: (F.length(t) >= 3) & ~t.isin(*SYMPTOM_STOP_WORDS))
    said = [F.array_distinct(words), bigrams(words)]
    for _, block, languages in reversed(SCRIPTS):
        entries = [(k, v) for n in languages for k, v in (lexicon or {}).get(n, {}).items()]
        if entries:
            found = F.regexp_extract_all(x, F.lit(f"[{block}]+"), F.lit(0))
            pairs = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(v).alias("v")) for k, v in entries])
            said.insert(0, F.flatten(F.transform(found, lambda w: F.transform(F.filter(pairs, lambda e: F.contains(w, e["k"]) | F.contains(e["k"], w)), lambda e: e["v"]))))
    return F.array_distinct(F.concat(*said))


def matched(wanted: Column, text: Column) -> Column:
    """Which wanted tokens a text has: by stem of a word, or as a part of the text as it stands."""
    plain = symptom_text(text)
    stems = F.transform(F.filter(F.split(plain, "[^a-z0-9]+"), lambda w: w != ""), stem)
    return F.filter(wanted, lambda t: (t != "") & (F.array_contains(stems, stem(t)) | F.contains(plain, t)))


def char_ngrams(x: Column, low: int, high: int) -> Column:
    """Character n-grams of the text without separators."""
    packed = F.regexp_replace(F.lower(x), "[^a-z0-9]+", "")
    letters = F.filter(F.split(packed, ""), lambda c: c != "")
    return F.concat(*[ngrams(letters, n, "") for n in range(low, high + 1)])


def bucket_of(feature: Column, seed: int, buckets: int) -> Column:
    """A stable bucket: the first 16 hexadecimal digits of md5(seed:feature), modulo the number of buckets."""
    number = F.conv(F.left(F.md5(F.concat(F.lit(f"{seed}:"), feature).cast("binary")), F.lit(16)), 16, 10).cast("decimal(20,0)")
    return F.pmod(number, F.lit(buckets).cast("decimal(20,0)")).cast("int")


def _has_pii(x: Column, kind: str) -> Column:
    found = x.rlike(PII[kind])
    return F.contains(x, F.lit("@")) & found if kind == "email" else found


def pii_kinds(x: Column, kinds: tuple[str, ...] = tuple(PII)) -> Column:
    """Which kinds of personal data a text holds, sorted."""
    return F.array_sort(F.array_compact(F.array(*[F.when(_has_pii(x, k), F.lit(k)) for k in kinds])))


def redact(x: Column, kinds: tuple[str, ...] = CONTACTS) -> Column:
    """Contact details, and identifiers where asked for, as REDACTION: phone numbers, addresses, then identifiers."""
    for k in (*CONTACTS, *IDENTIFIERS):
        if k in kinds:
            x = F.regexp_replace(x, PII[k], REDACTION)
    return x


def mojibake(x: Column) -> Column:
    """Marks of text decoded with the wrong encoding."""
    return x.rlike("�|Ã[\u0080-¿]|â€|Â[ -¿]")


def script_of(x: Column) -> Column:
    """The first script of SCRIPTS that occurs; latin where only Latin letters do, else unknown."""
    out = F.when(x.rlike("[A-Za-z]"), "latin").otherwise("unknown")
    for name, block, _ in reversed(SCRIPTS):
        out = F.when(x.rlike(f"[{block}]"), name).otherwise(out)
    return out


def hindi_or_marathi(x: Column, place: Column | None = None) -> Column:
    """struct(language, confidence) of a text in Devanagari: by words that only one has; a tie goes by the place, else to hi."""
    count = lambda words: sum((F.contains(x, F.lit(w)).cast("int") for w in words), F.lit(0))
    ahead = count(HINDI_WORDS) - count(MARATHI_WORDS)
    sure = F.least(F.lit(0.9), F.lit(0.5) + F.lit(0.1) * F.abs(ahead))
    there = F.coalesce(place.isin(*MARATHI_PLACES), F.lit(False)) if place is not None else F.lit(False)
    language = F.when(ahead > 0, "hi").when((ahead < 0) | there, "mr").otherwise("hi")
    return F.struct(language.alias("language"), F.when(ahead != 0, sure).when(there, 0.55).otherwise(0.5).alias("confidence"))


def detect_language(x: Column, place: Column | None = None) -> Column:
    """struct(script, language, candidates, confidence); language null without letters, or of a null or empty text."""
    script, dev = script_of(F.coalesce(x, F.lit(""))), hindi_or_marathi(x, place)
    language, candidates, sure = F.when(script == "latin", "en"), F.when(script == "latin", F.array(F.lit("en"))), F.when(script == "latin", 0.7)
    for name, _, languages in SCRIPTS:
        here = script == name
        language = F.when(here, dev["language"] if name == "devanagari" else F.lit(languages[0])).otherwise(language)
        sure = F.when(here, dev["confidence"] if name == "devanagari" else F.lit(0.7 if len(languages) == 1 else 0.5)).otherwise(sure)
        candidates = F.when(here, F.array(*map(F.lit, languages))).otherwise(candidates)
    return F.struct(script.alias("script"), language.alias("language"), F.coalesce(candidates, F.array().cast("array<string>")).alias("candidates"), F.coalesce(sure, F.lit(0.0)).alias("confidence"))


def script_language(x: Column) -> Column:
    return detect_language(x)["language"]


# Licences that are open, licences that aren't, and hosts whose pages aren't taken.
ALLOWED_LICENCES = (
    r"\bcc0\b", r"\bcc-by\b", r"\bcc-by-sa\b", r"creativecommons\.org/licenses/(by|zero|by-sa)", r"\bpublic\s*domain\b", r"\bgodl\b", r"open data license", r"\bmit\b|\bapache-?2\.0\b",
    r"explicit.*machine learning.*permission|permitted.*train",
)
BLOCKED_LICENCES = (r"\ball rights reserved\b", r"personal.*photos?", r"authenticated|login required|paywall", r"do not (reproduce|redistribute|copy)")
SOCIAL_HOSTS = ("facebook.com", "instagram.com", "whatsapp.com", "youtube.com", "youtu.be", "twitter.com", "x.com", "linkedin.com", "reddit.com")
PUBLIC_HOSTS = r"\.(gov|nic)\.in$"


def licence_gate(url: Column, licence: Column) -> Column:
    """BLOCK, ALLOW or REVIEW: social hosts (by the last two labels), public hosts, then what the licence says."""
    host = F.lower(F.substring_index(F.regexp_replace(F.coalesce(url, F.lit("")), "^https?://", ""), "/", 1))
    said = F.trim(F.coalesce(licence, F.lit("")))
    any_of = lambda patterns: said.rlike("(?i)" + "|".join(f"(?:{p})" for p in patterns))
    return (
        F.when(F.substring_index(host, ".", -2).isin(*SOCIAL_HOSTS), "BLOCK")
        .when(host.rlike(PUBLIC_HOSTS), "ALLOW")
        .when(said == "", "REVIEW")
        .when(any_of(BLOCKED_LICENCES), "BLOCK")
        .when(any_of(ALLOWED_LICENCES), "ALLOW")
        .otherwise("REVIEW")
    )


# The first part found, in this order, gives the score.
LICENCE_SCORES = {"GODL-India": 1.0, "CC0": 1.0, "CC-BY": 0.9, "public-domain": 1.0, "open": 0.8, "institutional": 0.6, "unknown": 0.3, "all-rights-reserved": 0.1}


def licence_score(licence: Column) -> Column:
    text = F.lower(F.coalesce(licence, F.lit("")))
    out = F.lit(LICENCE_SCORES["unknown"])
    for part, score in reversed(LICENCE_SCORES.items()):
        out = F.when(F.contains(text, F.lit(part.lower())), score).otherwise(out)
    return out


# Kinds of authority by key and name, and their scores.
AUTHORITIES = (
    ("government", "Government / ICAR / SAU", 1.0), ("research", "Peer-reviewed research", 0.95), ("government_extension", "KVK / government extension", 0.9),
    ("institution", "Recognised agriculture institution", 0.8), ("specialist", "Verified domain specialist", 0.65), ("blog", "Agriculture blog", 0.5),
    ("farmer", "Farmer anecdote", 0.35), ("social", "Anonymous social-media claim", 0.2),
)


def authority_score(authority: Column) -> Column:
    """By key or name; 0.35 for any other."""
    said = F.lower(F.trim(authority))
    out = F.lit(0.35)
    for key, name, score in reversed(AUTHORITIES):
        out = F.when(said.isin(key, name.lower()), score).otherwise(out)
    return out


def page_text(html: Column) -> Column:
    """Visible text: scripts, styles, navigation and tags gone, white space collapsed."""
    body = F.regexp_replace(html, r"(?is)<(script|style|nav|header|footer)\b.*?</\1\s*>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(body, r"(?s)<[^>]*>", " "), r"\s+", " "))


def page_title(html: Column) -> Column:
    found = F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))
    return F.when(found != "", found)


def slices(x: Column, size: int) -> Column:
    """Fixed-size pieces of a text; none of an empty one."""
    return F.when(F.length(x) > 0, F.transform(F.sequence(F.lit(0), F.floor((F.length(x) - 1) / size)), lambda i: F.substring(x, (i * size + 1).cast("int"), F.lit(size)))).otherwise(F.array().cast("array<string>"))


# Ways to talk a system out of its rules, by pattern and kind, and the longest query.
INJECTIONS = (
    (r"ignore\s+(?:all\s+|any\s+)?(?:previous|prior|above|earlier|following)\s+instructions", "instruction_override"),
    (r"(?:system\s*prompt|developer\s*message|system\s*message)", "prompt_leak"),
    (r"role\s*[:=]\s*(?:system|developer)", "role_override"),
    (r"reveal\s+(?:your|the)\s+(?:system\s*)?prompt", "prompt_leak"),
    (r"act\s+as\s+(?:an?\s+)?(?:unrestricted|jailbroken|dan\b)", "jailbreak"),
    (r"pretend\s+to\s+be\s+(?:a|an)?\s*(?:unrestricted|jailbroken)?\s*(?:gpt|assistant|llm|model)", "roleplay"),
    (r"<\|im_start\|>|<\|endoftext\|>|<\|\|.*?\|\|>", "token_marker"),
    (r"</?(?:system|developer|assistant|user|tool|function|function_calls?)\s*>", "tag_injection"),
    (r"\{\{\s*[a-z_][a-z0-9_]*\s*\}\}", "template_injection"),
    (r"\b(?:base64|eval|exec|execfile|__import__|os\.system|subprocess)\b", "code_exec"),
    (r"<script|javascript:", "code_exec"),
)
LONGEST_QUERY = 2000


def guard(query: Column, longest: int = LONGEST_QUERY) -> Column:
    """struct(query, flags, blocked): control signs stripped, white space collapsed, attacks flagged by kind, cut, changes flagged."""
    said = F.coalesce(query, F.lit(""))
    stripped = F.regexp_replace(said, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")
    tidy = F.trim(F.regexp_replace(stripped, r"(?U)\s+", " "))
    attacks = F.array_compact(F.array(*[F.when(tidy.rlike(f"(?i){p}"), F.lit(kind)) for p, kind in INJECTIONS]))
    cut = F.when(F.length(tidy) > longest, F.rtrim(F.left(tidy, F.lit(longest)))).otherwise(tidy)
    changes = F.array_compact(F.array(F.when(F.length(tidy) > longest, F.lit("truncated")), F.when(cut != said, F.lit("normalized"))))
    return F.struct(cut.alias("query"), F.concat(attacks, changes).alias("flags"), (F.size(attacks) > 0).alias("blocked"))


@F.pandas_udf(StringType())
def nfc(x):
    """Canonical composition and collapsed white space; there is no built-in for it."""
    import unicodedata

    return x.map(lambda t: None if t is None else " ".join(unicodedata.normalize("NFC", t).split()))
