"""Category of a name from weighted patterns, as one DataFrame expression.

Java's regex engine needs the flags U (Unicode classes and case folding) and d (only a line feed
ends a line for the dot). Most patterns begin with a word, so an ASCII name is cut into tokens once,
and a pattern runs only if one of them is a word it can begin with. All pattern scores are bound once,
in an array column; the rules and the choice of the best then read that array, so no pattern is
evaluated twice.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import CATEGORIES, CODE

LEAST = 0.3

# Fixed values: (category, weight, pattern), in the order in which a category's weights are added.
PATTERNS: list[tuple[str, float, str]] = [
    ("xxx", 1.0, r"\b(xxx|porn|brazzers|naughty[\s._-]?america|bangbros|realitykings|pornhub|xvideos|onlyfans|playboy|hustler|penthouse)\b"),
    ("xxx", 1.0, r"\b(blacked|tushy|vixen|mofos|fakehub|faketaxi|digital[\s._-]?playground|wicked[\s._-]?pictures|evil[\s._-]?angel)\b"),
    ("xxx", 1.0, r"\b(nubiles|babes\.com|met[\s._-]?art|x[\s._-]?art|hegre|femjoy|watch4beauty|sexart|joymii)\b"),
    ("xxx", 0.9, r"\b(jav|hentai|javhd|caribbeancom|tokyo[\s._-]?hot|s[\s._-]?cute|prestige|ideapocket|moodyz)\b"),
    ("xxx", 0.5, r"\b(erotic|nsfw|adult[\s._-]?only|18\+|explicit)\b"),
    ("xxx", 0.9, r"\b(milf|stepmom|stepsister|stepbrother|stepdad|creampie|gangbang|threesome|orgy|blowjob|handjob|cumshot)\b"),
    ("audiobook", 1.0, r"\b(audiobook|audio[\s._-]?book)\b"),
    ("audiobook", 1.0, r"\b(narrated[\s._]by|read[\s._]by|unabridged|abridged)\b"),
    ("audiobook", 0.9, r"\b(audible|librivox|libro\.fm|libby|overdrive|chirp|kobo[\s._]audiobook)\b"),
    ("anime", 1.0, r"\[(subsplease|erai[\s._-]?raws|judas|ember|horriblesubs|commie|coalgirls|doki|asw|yameii|sakurato)\]"),
    ("anime", 1.0, r"\[(hs|davinci|tenrai|kawaiika[\s._-]?raws|anime[\s._-]?time|sallysubs|asenshi|vivid|underwater)\]"),
    ("anime", 1.0, r"\[(kaleido|tsundere|hiryuu|chihiro|mazui|funi|crunchyroll|animekaizoku|bonkai77|reaperz)\]"),
    ("anime", 1.0, r"\[(moodkiller|kawaiisubs|cerberus|kuchikirukia|beatrice[\s._-]?raws|anidl|gskanime)\]"),
    ("anime", 1.0, r"\[(ohys[\s._-]?raws|leopard[\s._-]?raws|a[\s._-]?c|dmonhiro|cleo|nep|psa|sgt|sxales)\]"),
    ("anime", 0.7, r"\b(anime|donghua|nyaa|mal[\s._]id)\b"),
    ("anime", 0.9, r"\[.+\]\s+.+\s+-\s+\d+\s+\[(1080p|720p|480p)"),
    ("anime", 0.3, r"\[[0-9A-Fa-f]{8}\]"),
    ("course", 1.0, r"\b(udemy|coursera|skillshare|lynda|linkedin[\s._]learning|masterclass|pluralsight)\b"),
    ("course", 1.0, r"\b(udacity|edx|brilliant|codecademy|treehouse|packt|o'reilly[\s._]?media)\b"),
    ("course", 1.0, r"\b(khan[\s._]academy|wondrium|great[\s._]courses|mit[\s._]ocw|stanford[\s._]online)\b"),
    ("course", 0.9, r"\b(datacamp|freecodecamp|egghead|laracasts|frontendmasters|zerotomastery|academind)\b"),
    ("course", 0.5, r"\b(tutorial|course|bootcamp|lecture|workshop|training|lesson)\b"),
    ("tv", 1.0, r"S\d{2}E\d{2}"),
    ("tv", 0.7, r"S\d{2}\b"),
    ("tv", 0.9, r"\bseason[\s._]\d+"),
    ("tv", 0.9, r"\bcomplete[\s._](series|season)"),
    ("tv", 0.8, r"\d+x\d{2}\b"),
    ("tv", 0.9, r"E\d{2}[\s._-]?E\d{2}"),
    ("tv", 0.8, r"\b(miniseries|mini[\s._-]?series|limited[\s._-]?series)\b"),
    ("tv", 0.8, r"\b(season[\s._]?pack|complete[\s._]?pack)\b"),
    ("tv", 0.6, r"\b(HDTV|PDTV|DSR|TVRip)\b"),
    ("game", 1.0, r"\b(CODEX|SKIDROW|FitGirl|RELOADED|GOG|PLAZA|TENOKE|DODI|ElAmigos|EMPRESS|RUNE)\b"),
    ("game", 1.0, r"\b(TiNYiSO|DARKSIDERS|RAZOR1911|HOODLUM|PROPHET|CPY|REPACK|DARKSiDERS)\b"),
    ("game", 1.0, r"\b(CHRONOS|ANOMALY|I_KnoW|SiMPLEX|ALI213|POSTMORTEM|3DM)\b"),
    ("game", 0.8, r"\b(game[\s._]of[\s._]the[\s._]year|GOTY)\b"),
    ("game", 0.6, r"\bDLC[\s._]"),
    ("game", 0.6, r"\bupdate[\s._]v\d"),
    ("game", 0.6, r"\b(repack|repacked)\b"),
    ("game", 0.8, r"\b(PS[2-5]|PS[\s._]?Vita|PSP|Xbox[\s._]?360|Xbox[\s._]?One|Xbox[\s._]?Series)\b"),
    ("game", 0.8, r"\b(Nintendo[\s._]?Switch|NSW|Wii[\s._]?U|GameCube|3DS|NDS|GBA)\b"),
    ("movie", 0.5, r"\b(1080p|2160p|4k|720p)\b"),
    ("movie", 0.6, r"\b(bluray|blu[\s._-]?ray|brrip|dvdrip|webrip|web[\s._-]?dl|hdtv|hdrip|remux)\b"),
    ("movie", 0.6, r"\b(camrip|hdcam|telesync|telecine|dvdscr|screener|workprint)\b"),
    ("movie", 0.3, r"\b(x264|x265|hevc|h\.?264|h\.?265|xvid|divx)\b"),
    ("movie", 0.3, r"\b(aac|dts|dts[\s._-]?hd|atmos|truehd|10bit|hdr|hdr10|dolby[\s._]?vision)\b"),
    ("movie", 0.5, r"\b(SPARKS|YIFY|YTS|RARBG|EVO|AMIABLE|FGT|GECKOS|FLUX|CMRG)\b"),
    ("movie", 0.2, r"\(\d{4}\)"),
    ("movie", 0.3, r"\b(multi[\s._-]?subs?|eng[\s._-]?sub|subtitles?)\b"),
    ("music", 0.8, r"\b(discography|album|vinyl|greatest[\s._]hits|compilation|anthology)\b"),
    ("music", 0.6, r"\b(EP|single|mixtape|bootleg|live[\s._]at|live[\s._]in|concert[\s._]recording)\b"),
    ("music", 0.7, r"\bFLAC\b"),
    ("music", 0.7, r"\b(320kbps|256kbps|192kbps|V0|CBR|VBR|lossless)\b"),
    ("music", 0.7, r"\b(24bit|16bit|44\.1kHz|48kHz|96kHz|192kHz|hi[\s._-]?res)\b"),
    ("music", 0.4, r"\b(records|recordings|label|soundtrack|OST|score)\b"),
    ("software", 0.5, r"\.(exe|msi|dmg|pkg|deb|rpm|apk)\b"),
    ("software", 0.4, r"\b(windows|macos|mac[\s._]os[\s._]x|linux|portable)\b"),
    ("software", 0.5, r"\b(crack|cracked|keygen|patch|serial|activator|loader|pre[\s._-]?activated)\b"),
    ("software", 0.3, r"\b(x64|x86|arm64|64[\s._-]?bit|32[\s._-]?bit)\b"),
    ("software", 0.7, r"\b(adobe|autodesk|jetbrains|microsoft[\s._](office|visual|windows))\b"),
    ("software", 0.7, r"\b(vmware|parallels|solidworks|autocad|matlab|photoshop|illustrator|premiere)\b"),
    ("software", 0.15, r"\bv\d+\.\d+(\.\d+)?\b"),
    ("book", 0.9, r"\b(ebook|e[\s._-]?book|epub|kindle[\s._]edition)\b"),
    ("book", 0.8, r"\bpdf[\s._](collection|pack|bundle)\b"),
    ("book", 0.6, r"\b(o'reilly|wiley|springer|elsevier|penguin|harper[\s._]?collins|macmillan|mcgraw[\s._]?hill)\b"),
    ("book", 0.6, r"\b(apress|manning|pragmatic|addison[\s._]?wesley|pearson|oxford[\s._]university[\s._]press)\b"),
    ("book", 0.8, r"\b(isbn|978[\s._-]?\d)\b"),
    ("book", 0.7, r"\b(calibre|libgen|library[\s._]genesis|z[\s._-]?library|sci[\s._-]?hub)\b"),
    ("book", 0.6, r"\b(comic|manga|graphic[\s._]novel|marvel|dc[\s._]comics|dark[\s._]horse)\b"),
]
# Fixed values: (boosted category, needs a score of, pattern or none, boost), applied in this order.
EPISODE, BRACKETS = r"S\d{2}E\d{2}", r"\[.+\]"
SCENE = r"\b(CODEX|SKIDROW|FitGirl|RELOADED|GOG|PLAZA|TENOKE|DODI|ElAmigos|EMPRESS|RUNE|TiNYiSO|DARKSIDERS|RAZOR1911|HOODLUM|PROPHET|CPY)\b"
BOOSTS = [("tv", "movie", EPISODE, True, 0.5), ("anime", "movie", BRACKETS, False, 0.5), ("game", "software", SCENE, True, 0.5), ("course", "software", None, True, 0.3)]
XXX_BOOST = 0.5
# Weights by file extension.
EXTENSIONS: dict[str, dict[str, float]] = {
    ".mkv": {"movie": 0.4, "tv": 0.3, "anime": 0.2, "xxx": 0.1},
    ".avi": {"movie": 0.4, "tv": 0.3, "anime": 0.2, "xxx": 0.1},
    ".mp4": {"movie": 0.3, "tv": 0.25, "xxx": 0.2, "anime": 0.1, "course": 0.15},
    ".wmv": {"movie": 0.3, "tv": 0.2, "xxx": 0.4, "anime": 0.1},
    ".ts": {"movie": 0.3, "tv": 0.4, "anime": 0.2, "xxx": 0.1},
    ".mp3": {"music": 0.7, "audiobook": 0.2, "course": 0.1},
    ".flac": {"music": 0.9, "audiobook": 0.1},
    ".m4a": {"music": 0.5, "audiobook": 0.4, "course": 0.1},
    ".m4b": {"audiobook": 1.0},
    ".epub": {"book": 1.0},
    ".mobi": {"book": 1.0},
    ".azw3": {"book": 1.0},
    ".cbr": {"book": 1.0},
    ".cbz": {"book": 1.0},
    ".pdf": {"book": 0.5, "course": 0.3, "software": 0.2},
    ".exe": {"software": 0.6, "game": 0.4},
    ".msi": {"software": 0.8, "game": 0.2},
    ".dmg": {"software": 0.8, "game": 0.2},
    ".iso": {"game": 0.4, "software": 0.4, "movie": 0.2},
    ".nsp": {"game": 1.0},
    ".xci": {"game": 1.0},
}


def _matches(name: Column, pattern: str, fold: bool = True) -> Column:
    return name.rlike(("(?iUd)" if fold else "(?Ud)") + pattern)


def _first_tokens(text: str) -> set[str] | None:
    """The alphanumeric runs that a match of this part of a pattern can begin with, if they can be listed."""
    done, now, i = set(), {""}, 0
    while i < len(text):
        rest = text[i:]
        if gap := re.match(r"\[\\s\._-?\]\?|\\\.\?", rest):  # a separator that may be missing
            done |= now
            i += gap.end()
        elif rest.startswith(("[\\s", "\\.", "\\b", "\\+", "'", "_")):  # the run ends here
            return done | now
        elif span := re.match(r"\[(\d)-(\d)\]", rest):
            now = {c + str(d) for c in now for d in range(int(span[1]), int(span[2]) + 1)}
            i += span.end()
        elif rest == "\\d":
            now = {c + str(d) for c in now for d in range(10)}
            i += 2
        elif rest[0].isalnum() and not rest[1:2] in ("+", "*", "{"):
            more = {c + rest[0].lower() for c in now}
            optional = rest[1:2] == "?"
            now = now | more if optional else more
            i += 1 + optional
        else:
            return None
    return done | now


def first_tokens(pattern: str) -> set[str] | None:
    """Tokens of which an ASCII name that matches must hold one, if the pattern begins at the edge of a token."""
    group = re.fullmatch(r"(?:\\b|\\\[)\((.*)\)(?:\\b|\\\])", pattern)
    if not group and not pattern.startswith("\\b"):
        return None
    parts, depth = [""], 0
    for c in group[1] if group else pattern[2:]:
        depth += (c == "(") - (c == ")")
        if c == "|" and not depth and group:
            parts.append("")
        else:
            parts[-1] += c
    found = [_first_tokens(p) for p in parts]
    return None if any(f is None or "" in f for f in found) else set().union(*found)


#: Patterns that a name can only match if it holds a certain token: a bit for each, and the bits by token.
GATES = {p: bit for bit, p in enumerate(p for _, _, p in PATTERNS if first_tokens(p))}
TOKEN_BITS: dict[str, int] = {}
for _pattern, _bit in GATES.items():
    for _token in first_tokens(_pattern):
        TOKEN_BITS[_token] = TOKEN_BITS.get(_token, 0) | 1 << _bit


def possible(name: Column) -> Column:
    """Bits of the gated patterns that a name may match; a name with other than ASCII characters may match all."""
    bits = F.create_map(*[F.lit(x) for pair in sorted(TOKEN_BITS.items()) for x in pair])
    tokens = F.filter(F.split(F.lower(name), "[^a-z0-9]+"), lambda t: t.isin(*sorted(TOKEN_BITS)))  # a map is searched from its start
    some = F.aggregate(tokens, F.lit(0).cast("long"), lambda m, t: m.bitwiseOR(F.coalesce(bits[t], F.lit(0)).cast("long")))
    return F.when(F.octet_length(name) == F.char_length(name), some).otherwise(F.lit(-1).cast("long"))


def scores(name: Column, gate: Column) -> Column:
    """Array of eleven sums of weights, indexed by category code; `gate` is `possible` of the name."""
    sums = [F.lit(0.0)] * len(CATEGORIES)
    for category, weight, pattern in PATTERNS:
        match = _matches(name, pattern)
        if pattern in GATES:
            match = (gate.bitwiseAND(F.lit(1 << GATES[pattern]).cast("long")) != 0) & match
        sums[CODE[category]] = sums[CODE[category]] + F.when(match, F.lit(weight)).otherwise(F.lit(0.0))
    return F.array(*sums)


def disambiguated(name: Column, s: Column) -> Column:
    """The scores after the rules for names that fit several categories."""
    at = [s[i] for i in range(len(CATEGORIES))]
    out = list(at)
    xxx = CODE["xxx"]
    others = F.greatest(*(at[i] for i in range(len(at)) if i != xxx))
    out[xxx] = F.when(at[xxx] > 0, F.greatest(at[xxx], others) + XXX_BOOST).otherwise(at[xxx])
    for winner, rival, pattern, fold, boost in BOOSTS:
        w, r = at[CODE[winner]], at[CODE[rival]]
        rule = (w > 0) & (r > 0)
        if pattern:
            rule = rule & _matches(name, pattern, fold)
        out[CODE[winner]] = F.when(rule, w + boost).otherwise(w)
    return F.array(*out)


def best(s: Column) -> Column:
    """Code of the highest score; the lowest code wins a tie, and below LEAST it is `other`."""
    top = F.array_max(s)
    return F.when(top < LEAST, F.lit(0)).otherwise(F.array_position(s, top) - 1).cast("tinyint")


def with_category(df: DataFrame, name: str = "name") -> DataFrame:
    """Adds `category`; a null name counts as empty."""
    text = F.coalesce(F.col(name), F.lit(""))
    scored = df.withColumn("_gate", possible(text)).withColumn("_scores", scores(text, F.col("_gate")))
    return scored.withColumn("_final", disambiguated(text, F.col("_scores"))).withColumn("category", best(F.col("_final"))).drop("_gate", "_scores", "_final")


def label(code: Column) -> Column:
    """Category label; unknown and missing codes are `other`."""
    labels = F.array(*map(F.lit, CATEGORIES))
    return F.when(code.between(0, len(CATEGORIES) - 1), F.get(labels, code.cast("int"))).otherwise("other")


def scores_sql(name: str) -> list[str]:
    """The scores as SQL expressions, for checking."""
    sums = ["0.0::DOUBLE"] * len(CATEGORIES)
    quote = lambda p: p.replace("'", "''")
    for category, weight, pattern in PATTERNS:
        sums[CODE[category]] += f" + CASE WHEN regexp_matches({name}, '(?i){quote(pattern)}') THEN {weight}::DOUBLE ELSE 0::DOUBLE END"
    return sums


def category_sql(source: str, key: str, name: str = "name") -> str:
    """SQL for (key, category) of the rows of `source`, for checking."""
    raw = ", ".join(f"{s} AS s{i}" for i, s in enumerate(scores_sql(name)))
    others = ", ".join(f"s{i}" for i in range(11) if i != 7)
    f = [f"s{i}" for i in range(11)]
    f[7] = f"CASE WHEN s7 > 0 THEN greatest(s7, {others}) + {XXX_BOOST}::DOUBLE ELSE s7 END"
    for winner, rival, pattern, fold, boost in BOOSTS:
        w, r = CODE[winner], CODE[rival]
        rule = f"s{w} > 0 AND s{r} > 0" + (f" AND regexp_matches({name}, '{'(?i)' * fold}{pattern}')" if pattern else "")
        f[w] = f"CASE WHEN {rule} THEN s{w} + {boost}::DOUBLE ELSE s{w} END"
    final = ", ".join(f"{x} AS f{i}" for i, x in enumerate(f))
    top = "greatest(" + ", ".join(f"f{i}" for i in range(11)) + ")"
    pick = " ".join(f"WHEN f{i} = {top} THEN {i}" for i in range(11))
    return f"SELECT {key}, CAST(CASE WHEN {top} < {LEAST}::DOUBLE THEN 0 {pick} END AS TINYINT) AS category FROM (SELECT {key}, {final} FROM (SELECT {key}, {name}, {raw} FROM {source}))"
