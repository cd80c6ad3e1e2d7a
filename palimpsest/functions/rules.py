"""Routing, kinds, merge policies and risk as column expressions: ordered CASE chains that Catalyst can fold and push."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Path fragments, folder names and weights of the script format.
SCRIPT_FOLDERS = (
    "common/traits", "common/decisions", "common/scripted_effects", "common/scripted_triggers", "common/on_action",
    "common/character_interactions", "common/script_values", "common/buildings", "common/culture", "common/religion",
    "common/governments", "common/laws", "common/casus_belli_types", "common/schemes", "common/activities",
    "common/artifacts", "common/dynasty_perks", "common/lifestyle", "common/focuses", "common/perks",
    "common/men_at_arms_types", "common/modifiers", "common/customizable_localization", "common/flavorization",
    "common/game_rules", "common/important_actions", "common/nicknames", "common/landed_titles",
    "common/accolade_names", "history/titles/", "events/",
)
LOOKUP_FOLDERS = ("history/provinces/", "history/characters/", "common/dynasties/", "name_lists/", "/names/", "coat_of_arms/coat_of_arms/")
SKIPPED = (
    "gfx/", "/fonts/", "/sounds/", "/music/", "/licenses/", "#backup/", "/generated/", "checksum_manifest.txt", ".mod",
    "notes.txt", "to do.txt", "todo.txt", "readme.txt", "readme.md", "changelog.txt", "changelog.md", "credits.txt",
    "description.txt", "steam_description.txt", "ibl-description", "me-ibl_description", "ofl.txt", "license.txt",
    "license.md", "gui/", "map_data/", "terrain/", "adjacencies", "positions.txt", "interface/", "tests/", "test_",
    "_test.txt", "common/bookmark_portraits/",
)
DOMAINS = (
    ("common/on_action", "on_action"), ("common/decisions", "decision"), ("common/scripted_effects", "scripted_effect"),
    ("common/scripted_triggers", "scripted_trigger"), ("common/traits", "trait"), ("common/culture/traditions", "tradition"),
    ("common/culture/cultures", "culture"), ("common/religion/religions", "religion"), ("common/religion/doctrines", "doctrine"),
    ("common/modifiers", "modifier"), ("common/character_interactions", "character_interaction"), ("common/defines", "defines"),
    ("common/men_at_arms_types", "maa_type"), ("common/buildings", "building"), ("common/casus_belli_types", "casus_belli"),
    ("common/schemes", "scheme"), ("common/laws", "law"), ("events/", "event"), ("localization/", "localization"), ("gui/", "gui"),
)
POLICIES = (("common/on_action", "container_merge"), ("common/defines", "per_key_override"), ("localization", "per_key_override"), ("gui", "fios"))
DOMAIN_RISK = {
    "on_action": 30, "event": 25, "scripted_effect": 15, "scripted_trigger": 15, "decision": 10, "trait": 10, "defines": 15,
    "gui": 25, "localization": 5, "culture": 10, "tradition": 10, "religion": 15, "faith": 15, "modifier": 5, "maa_type": 10,
    "building": 10, "content": 10,
}
#: Weights of files and of names inside them in the report; units of conflict have DOMAIN_RISK.
REPORT_RISK = {
    "on_action": 40, "events": 35, "character_interactions": 35, "gui": 45, "interface": 40, "scripted_effect": 25,
    "scripted_trigger": 25, "decisions": 30, "traits": 20, "landed_titles": 25, "modifiers": 15, "defines": 10,
    "localization": 5, "gfx": 10, "portrait": 20, "other": 15,
}
#: Path segments and the report's domain of files below them.
REPORT_DOMAINS = {
    "on_action": "on_action", "on_actions": "on_action", "scripted_effects": "scripted_effect", "scripted_triggers": "scripted_trigger",
    "decisions": "decisions", "defines": "defines", "localization": "localization", "modifiers": "modifiers",
    "static_modifiers": "modifiers", "landed_titles": "landed_titles", "traits": "traits", "events": "events",
    "script_values": "script_values", "character_interactions": "character_interactions", "gui": "gui", "interface": "interface",
    "gfx": "gfx", "portrait": "portrait", "coat_of_arms": "coat_of_arms", "culture": "culture", "religion": "religion",
    "governments": "governments", "laws": "laws", "casus_belli_types": "casus_belli",
}
#: Slots of a container whose items add up over sources, and those of which the last source's counts.
APPENDED_SLOTS = ("events", "on_actions", "random_events", "random_on_actions", "first_valid", "first_valid_on_action")
SINGLE_SLOTS = ("effect", "trigger", "weight_multiplier", "fallback")
RESERVED = (
    "namespace", "yes", "no", "true", "false", "null", "none", "if", "else", "limit", "trigger", "effect", "modifier",
    "AND", "OR", "NOT", "NOR", "NAND", "macro", "scripted_trigger", "scripted_effect", "first_valid", "random_valid", "fallback",
    "pattern_textures", "pattern_layout", "variation", "object", "cubemap", "environment", "lights", "camera", "assets",
    "characters", "artifacts", "shadows_fade", "shadows_strength", "default_camera", "visual_culture_level", "support_type",
    "audio_culture", "tonemap_function", "layer", "exposure_function", "bright_threshold", "bloom_width", "bloom_scale",
    "exposure", "cubemap_intensity", "war", "character", "category", "atlas", "posteffect_values", "game_object_locator",
)
COMPATIBILITY = ("compatch", "compatibility", "patch", "compat", "fix", "hotfix", "tweak", "override")
KINDS = {
    "common/scripted_effects": "scripted_effect", "common/scripted_triggers": "scripted_trigger",
    "common/scripted_modifiers": "scripted_modifier", "common/script_values": "script_value", "common/on_action": "on_action",
    "common/traits": "trait", "common/character_interactions": "interaction", "common/schemes": "scheme",
    "common/lifestyle": "lifestyle", "common/focuses": "focus", "common/perks": "perk", "common/nicknames": "nickname",
    "common/relations": "relation", "common/culture/cultures": "culture", "common/culture/traditions": "tradition",
    "common/culture/pillars": "cultural_pillar", "common/culture/eras": "cultural_era",
    "common/culture/innovations": "innovation", "common/religion/religions": "religion",
    "common/religion/holy_sites": "holy_site", "common/religion/doctrines": "doctrine",
    "common/religion/fervor_modifiers": "fervor_modifier", "common/landed_titles": "title", "common/governments": "government",
    "common/laws": "law", "common/succession_election": "election", "common/vassal_contracts": "vassal_contract",
    "common/holdings": "holding", "common/buildings": "building", "common/terrain_types": "terrain",
    "common/province_terrain": "province_terrain", "common/economic_values": "economic_value",
    "common/men_at_arms_types": "maa_type", "common/combat_phase_events": "combat_event",
    "common/casus_belli_types": "cb_type", "common/war_goals": "war_goal", "common/activities": "activity",
    "common/council_positions": "council_position", "common/court_positions": "court_position",
    "common/court_types": "court_type", "common/diarchies": "diarchy", "common/domiciles": "domicile",
    "common/artifacts": "artifact", "common/inspiration_types": "inspiration", "common/dynasties": "dynasty",
    "common/dynasty_perks": "dynasty_perk", "common/dynasty_legacies": "dynasty_legacy",
    "common/dynasty_houses": "dynasty_house", "common/decisions": "decision", "common/important_actions": "important_action",
    "events": "event", "common/event_backgrounds": "event_background", "common/event_themes": "event_theme",
    "common/customizable_localization": "custom_loc", "common/flavorization": "flavorization",
    "common/named_colors": "named_color", "gfx/portraits/portrait_modifiers": "portrait_modifier",
    "gfx/coat_of_arms": "coa", "common/modifiers": "modifier", "common/static_modifiers": "static_modifier",
    "common/triggered_modifiers": "triggered_modifier", "common/opinion_modifiers": "opinion_modifier",
    "common/event_modifiers": "event_modifier", "common/defines": "define", "common/bookmark_portraits": "bookmark_portrait",
    "common/bookmarks": "bookmark", "common/game_rules": "game_rule", "common/achievements": "achievement",
    "common/story_cycles": "story_cycle", "common/secret_types": "secret_type", "common/hooks": "hook",
    "common/travel": "travel", "common/struggle": "struggle",
}
#: name, pattern, priority: the first that matches counts.
LOG_CATEGORIES = (
    ("fatal_crash", r"fatal\(crash\)", 1),
    ("encoding_error", r"(Incorrect MOD descriptor|Invalid supported_version|Illegal localization break)", 2),
    ("script_system_error", r"jomini_script_system\.cpp", 2),
    ("missing_reference", r"(not defined|not found|does not exist|Unknown)", 3),
    ("scope_error", r"(scope|context)", 3),
    ("event_error", r"(eventmanager|jomini_event_queue_manager)", 3),
    ("duplicate_key", r"Duplicate (localization key|entry)", 4),
    ("localization_missing", r"(Key is missing localization|missing localization key)", 4),
    ("gui_warning", r"(pdx_gui|Widget cannot have)", 4),
    ("portrait_error", r"portraitcontext", 4),
    ("audio_error", r"audio2_fmod_sound", 5),
)
#: The same for the game's log and for the debug log, with what each is about.
GAME_LOG_CATEGORIES = (
    ("casus_belli_error", r"casus_belli\.cpp", 2, "Casus belli definition errors"),
    ("decision_error", r"decision_type\.cpp", 3, "Decision configuration errors"),
    ("triggered_string_error", r"triggered_string\.cpp", 3, "Triggered string reference errors"),
    ("mtth_error", r"mtthimpl\.cpp", 2, "MTTH calculation errors"),
    ("landed_title_error", r"landed_title_template\.cpp", 3, "Landed title definition errors"),
    ("coat_of_arms_error", r"coat_of_arms", 4, "Coat of Arms errors"),
    ("culture_error", r"culture_template\.cpp|culture_name_equivalency\.cpp", 3, "Culture definition errors"),
    ("religion_error", r"religion_templates\.cpp", 3, "Religion/faith errors"),
    ("holy_site_error", r"faith_holy_site_template\.cpp", 3, "Holy site configuration errors"),
    ("bookmark_error", r"bookmark\.cpp", 4, "Bookmark/character selection errors"),
    ("building_error", r"building_type\.cpp", 4, "Building/gfx culture flag errors"),
    ("flavorization_error", r"flavorizing\.cpp", 4, "Flavorization/title naming errors"),
    ("portrait_error", r"portrait", 5, "Portrait/appearance errors"),
    ("gui_error", r"pdx_gui|widget", 5, "GUI/interface errors"),
)
DEBUG_LOG_CATEGORIES = (
    ("system_init", r"Log system initialized|Architecture|worker threads", 5, "System initialization"),
    ("gpu_info", r"Adapter \d+:|Selected adapter:", 5, "GPU/graphics information"),
    ("dlc_info", r"^DLC:", 5, "DLC loading information"),
    ("mod_info", r"^Mod:", 5, "Mod loading information"),
    ("network_info", r"POPS|Matchmaking|Nakama", 5, "Network/online services"),
    ("settings_info", r"settings|pdx_settings", 5, "Settings loading"),
    ("define_warning", r"Define .* not specified", 4, "Missing defines (usually harmless)"),
)
#: Routing table: path fragments with their envelope, in order; then skipped extensions; then extensions with theirs.
ENVELOPE_PATHS = (
    ("history/characters/", "E_LOOKUP_CHARACTERS"), ("history/provinces/", "E_LOOKUP_PROVINCES"),
    ("common/culture/name_lists/", "E_LOOKUP_NAMES"), ("common/religion/holy_sites/", "E_LOOKUP_HOLY_SITES"),
    ("common/dynasties/", "E_LOOKUP_DYNASTIES"), ("licenses/", "E_SKIP"), ("credits.txt", "E_SKIP"), ("credit.txt", "E_SKIP"),
    ("description.txt", "E_SKIP"), ("compatibility.txt", "E_SKIP"), ("modding_info.txt", "E_SKIP"), ("STEAM_DESCRIPTION.txt", "E_SKIP"),
    ("changelog", "E_SKIP"), ("CHANGES.txt", "E_SKIP"), ("Notes.txt", "E_SKIP"), ("intr.txt", "E_SKIP"),
    ("SpecialThanksContributors.txt", "E_SKIP"), ("House_Traditions.txt", "E_SKIP"), ("README", "E_SKIP"), ("gui/", "E_SKIP"),
    ("gfx/", "E_SKIP"), ("map_data/", "E_SKIP"), ("fonts/", "E_SKIP"), ("music/", "E_SKIP"), ("sound/", "E_SKIP"),
    ("dlc_metadata/", "E_SKIP"), ("content_source/", "E_SKIP"),
)
SKIPPED_EXTENSIONS = (
    ".dds", ".png", ".jpg", ".jpeg", ".gif", ".bmp", ".tga", ".wav", ".mp3", ".ogg", ".bank", ".wem", ".mesh", ".anim",
    ".skeleton", ".asset", ".settings", ".shader", ".mod", ".ttf", ".otf", ".fnt", ".bik", ".bk2", ".psd",
)
ENVELOPES = {".txt": "E_SCRIPT", ".yml": "E_LOC"}
#: How sure the report is of each domain's merge behaviour; "low" for all others.
MERGE_CONFIDENCE = {
    "localization": "high", "defines": "high", "script_values": "medium", "scripted_effect": "medium", "scripted_trigger": "medium",
    "decisions": "medium", "traits": "medium", "events": "medium", "character_interactions": "medium",
}
#: Prefixes of unit keys that differ from the domain's name.
UNIT_PREFIXES = {"character_interaction": "interaction", "localization": "loc", "maa_type": "maa", "casus_belli": "cb"}
MATCH_TYPES = ("exact", "prefix", "stem", "suffix", "contains", "suffix_tokens", "flex_underscore")
#: Domains of files that the report always calls risky, and the texts of a file's reasons.
HOT_DOMAINS = ("on_action", "events", "gui", "interface")
FILE_REASONS = {"hot": "hotspot_domain", "many": "_candidates", "size": "large_size_delta", "ids": "has_id_conflicts", "many_ids": "many_id_conflicts_inside"}
# End of fixed values.


def first_of(cases: Sequence[tuple[Column, object]], default: object) -> Column:
    """The value of the first case that holds."""
    out = F
    for when, value in cases:
        out = out.when(when, value)
    return out.otherwise(default)


def normal_path(path: Column) -> Column:
    """Lower case, forward slashes, none at either end."""
    return F.lower(F.regexp_replace(F.translate(path, "\\", "/"), "^/+|/+$", ""))


def holds_any(text: Column, parts: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(p.lower()) for p in parts])


def route(path: Column) -> Column:
    """How a file is processed: SCRIPT, LOCALIZATION, LOOKUPS or SKIP, with the reason."""
    low = F.lower(F.translate(path, "\\", "/"))
    ext = F.lower(F.regexp_extract(low, r"[^/](\.[^./]+)$", 1))
    pick = lambda kind, why: F.struct(F.lit(kind).alias("route"), F.lit(why).alias("reason"))
    return first_of(
        [
            ((ext == ".yml") & low.contains("localization/"), pick("LOCALIZATION", "localization file")),
            (ext == ".yml", pick("SKIP", "yml outside localization")),
            (ext != ".txt", pick("SKIP", "not a txt file")),
            (holds_any(low, SKIPPED), pick("SKIP", "in skip list")),
            (holds_any(low, LOOKUP_FOLDERS), pick("LOOKUPS", "lookup data")),
            (holds_any(low, SCRIPT_FOLDERS), pick("SCRIPT", "script in known folder")),
            (F.translate(path, "\\", "/").startswith("common/") | F.translate(path, "\\", "/").startswith("events/"), pick("SCRIPT", "txt in common or events")),
        ],
        pick("SKIP", "unknown location"),
    )


def domain(path: Column) -> Column:
    low = F.lower(F.translate(path, "\\", "/"))
    return first_of([(low.contains(p), F.lit(d)) for p, d in DOMAINS], F.lit("content"))


def kind(path: Column) -> Column:
    """The kind of what a file defines: of the fragments in its path, the longest one's; else its folder below common/
    without the plural s; else 'definition'."""
    low = F.lower(F.translate(path, "\\", "/"))
    longest = sorted(KINDS.items(), key=lambda x: -len(x[0]))
    folder = F.regexp_extract(low, r"/common/([^/]+)", 1)
    return first_of([*((low.contains(p), F.lit(d)) for p, d in longest), (folder != "", F.regexp_replace(folder, "s+$", ""))], F.lit("definition"))


def policy(path: Column) -> Column:
    """Merge policy of a folder: override unless its path begins with one of the exceptions."""
    folder = F.regexp_replace(F.translate(path, "\\", "/"), "^/+|/+$", "")
    return first_of([(folder.startswith(p), F.lit(name)) for p, name in POLICIES], F.lit("override"))


def merge_behavior(policy_name: Column) -> Column:
    return first_of([(policy_name.isin("override", "fios"), F.lit("replace")), (policy_name == "container_merge", F.lit("append")), (policy_name == "per_key_override", F.lit("merge_by_id"))], F.lit("unknown"))


def merge_capability(behavior: Column) -> Column:
    return first_of([(behavior.isin("append", "merge_by_id"), F.lit("guided_merge")), (behavior == "replace", F.lit("winner_only"))], F.lit("ai_merge"))


def report_type(path: Column) -> Column:
    low = F.lower(path)
    return first_of(
        [
            (low.endswith(".yml") | low.contains("localization"), F.lit("localization")),
            (low.rlike(r"\.(dds|png|tga)$"), F.lit("gfx")),
            (low.endswith(".gui"), F.lit("gui")),
            (holds_any(low, ("common/", "events/", "history/")), F.lit("script")),
        ],
        F.lit("other"),
    )


def is_symbol_name(name: Column) -> Column:
    """Two characters at least, not reserved, and neither a number nor a date, which are digits with up to two dots."""
    rest = F.translate(name, "0123456789", "")
    part = lambda n: F.split_part(name, F.lit("."), F.lit(n))
    numeric = rest.isin("", ".") | ((rest == "..") & (part(2) != "") & (part(3) != ""))
    return F.coalesce((F.length(name) >= 2) & ~name.isin(*RESERVED) & ~numeric, F.lit(False))


def is_compatibility_patch(name: Column) -> Column:
    return F.coalesce(holds_any(F.lower(name), COMPATIBILITY), F.lit(False))


def mapped(pairs: dict[str, object], key: Column, default: object) -> Column:
    """The value of ``key`` in a fixed table."""
    return first_of([(key == k, F.lit(v)) for k, v in pairs.items()], default if isinstance(default, Column) else F.lit(default))


def unit_key(domain_name: Column, name: Column, namespace: Column | None = None) -> Column:
    """prefix:[namespace.]name; only events and defines have namespaces."""
    prefix = mapped(UNIT_PREFIXES, domain_name, domain_name)
    plain = F.concat_ws(":", prefix, name)
    if namespace is None:
        return plain
    return F.when(domain_name.isin("event", "defines") & (F.coalesce(namespace, F.lit("")) != ""), F.concat(prefix, F.lit(":"), namespace, F.lit("."), name)).otherwise(plain)


def report_domain(path: Column) -> Column:
    """The report's domain of a file: that of the first path segment that has one, else "other"."""
    parts = F.split(F.lower(F.translate(path, "\\", "/")), "/")
    known = F.filter(parts, lambda x: x.isin(*REPORT_DOMAINS))
    return mapped(REPORT_DOMAINS, F.get(known, F.lit(0)), "other")


def extension(path: Column) -> Column:
    """The last dot of a path's name and what follows, in lower case; empty without a dot that ends a name."""
    name = F.substring_index(F.lower(F.translate(path, "\\", "/")), "/", -1)
    dot = F.length(name) - F.length(F.substring_index(name, ".", -1))
    return F.when((dot > 1) & (dot < F.length(name)), F.substring(name, dot, F.length(name))).otherwise(F.lit(""))


def envelope(path: Column, paths: Sequence[tuple[str, str]] = ENVELOPE_PATHS, skipped: Sequence[str] = SKIPPED_EXTENSIONS, kinds: dict[str, str] = ENVELOPES) -> Column:
    """Which steps a file gets, by a routing table: the first fragment that its path holds; else skipped extensions;
    else its extension's envelope; else none."""
    low, ext = F.lower(F.translate(path, "\\", "/")), extension(path)
    return first_of([*((low.contains(p.lower()), F.lit(e)) for p, e in paths), (ext.isin(*skipped), F.lit("E_SKIP")), *((ext == k, F.lit(e)) for k, e in kinds.items())], F.lit("E_SKIP"))


def prefix_route(path: Column, rules: Sequence[tuple[str, Sequence[str], Sequence[str]]], default: str) -> Column:
    """The first rule (name, path prefixes, extensions) that a file meets: any of its prefixes and any of its extensions,
    where it has such; a rule with neither meets every file."""
    low, ext = F.lower(F.translate(path, "\\", "/")), extension(path)
    cases = []
    for name, prefixes, extensions in rules:
        ok = reduce(lambda a, b: a | b, [low.startswith(p.lower()) for p in prefixes]) if prefixes else F.lit(True)
        cases.append((ok & ext.isin(*extensions) if extensions else ok, F.lit(name)))
    return first_of(cases, F.lit(default))


def file_type(path: Column) -> Column:
    """The tag a stored file carries: its route in lower case."""
    return F.lower(route(path)["route"])


def domain_risk(domain_name: Column) -> Column:
    return first_of([(domain_name == d, F.lit(w)) for d, w in DOMAIN_RISK.items()], F.lit(10))


def risk_bucket(score: Column) -> Column:
    return first_of([(score >= 60, F.lit("high")), (score >= 30, F.lit("medium"))], F.lit("low"))


def _add(when: Column, points: object) -> Column:
    return F.when(when, points).otherwise(F.lit(0))


def unit_risk(domain_name: Column, candidates: Column, behavior: Column, over_base: Column, unknown_refs: Column, renamed: Column) -> Column:
    """0 to 100: the domain's weight, 10 for each candidate over two, and fixed surcharges."""
    score = domain_risk(domain_name) + F.greatest(candidates - 2, F.lit(0)) * 10
    score = score + _add(behavior == "unknown", F.lit(20)) + _add(over_base & (candidates > 1), F.lit(5)) + _add(unknown_refs, F.lit(15)) + _add(renamed, F.lit(20))
    return F.least(F.lit(100), score).cast("long")


def unit_reasons(candidates: Column, behavior: Column, over_base: Column, unknown_refs: Column, renamed: Column) -> Column:
    return F.concat_ws(
        "; ",
        F.when(candidates > 2, F.concat(candidates.cast("string"), F.lit(" sources touch it"))),
        F.when(behavior == "unknown", "unknown merge"),
        F.when(over_base & (candidates > 1), "base overwritten"),
        F.when(unknown_refs, "unknown references"),
        F.when(renamed, "renamed"),
    )


def file_risk(report_domain_name: Column, candidates: Column, size_delta: Column, inner_conflicts: Column) -> Column:
    score = mapped(REPORT_RISK, report_domain_name, REPORT_RISK["other"]) + F.greatest(candidates - 2, F.lit(0)) * 10 + _add(size_delta > 0.5, F.lit(10))
    return F.least(F.lit(100), score + F.when(inner_conflicts > 5, 10).when(inner_conflicts > 0, 5).otherwise(0)).cast("long")


def file_reasons(report_domain_name: Column, candidates: Column, size_delta: Column, inner_conflicts: Column) -> Column:
    return F.concat_ws(
        "; ",
        F.when(report_domain_name.isin(*HOT_DOMAINS), FILE_REASONS["hot"]),
        F.when(candidates > 2, F.concat(candidates.cast("string"), F.lit(FILE_REASONS["many"]))),
        F.when(size_delta > 0.5, FILE_REASONS["size"]),
        F.when(inner_conflicts > 5, FILE_REASONS["many_ids"]).when(inner_conflicts > 0, FILE_REASONS["ids"]),
    )


def id_risk(report_domain_name: Column, candidates: Column, unknown_refs: Column, uncertain: Column) -> Column:
    score = mapped(REPORT_RISK, report_domain_name, REPORT_RISK["other"]) + F.greatest(candidates - 2, F.lit(0)) * 15 + _add(unknown_refs, F.lit(15)) + _add(uncertain, F.lit(10))
    return F.least(F.lit(100), score).cast("long")


def id_uncertainty(report_domain_name: Column, uncertain: Column) -> Column:
    """Bucket of how unsure the report is of a name's merge: none, low or medium."""
    confidence = mapped(MERGE_CONFIDENCE, report_domain_name, "low")
    return first_of([((confidence == "high") & ~uncertain, F.lit("none")), (confidence == "medium", F.lit("low"))], F.lit("medium"))


def uncertainty(domain_name: Column, behavior: Column, differ: Column) -> Column:
    return first_of([(domain_name == "on_action", F.lit("medium")), (behavior == "unknown", F.lit("high")), (differ, F.lit("medium"))], F.lit("low"))


def log_category(message: Column, rules: Sequence[tuple] = LOG_CATEGORIES) -> Column:
    """Category and priority of a log message, by the first pattern found in it whatever the case."""
    pick = lambda name, p: F.struct(F.lit(name).alias("category"), F.lit(p).alias("priority"))
    return first_of([(message.rlike("(?i)" + r[1]), pick(r[0], r[2])) for r in rules], pick("unknown", 5))


def signature(message: Column) -> Column:
    """What a message has in common with others that differ in numbers: its first 100 characters, digits as N."""
    return F.regexp_replace(F.substring(message, 1, 100), r"\d+", "N")


def node_text(text: Column) -> Column:
    """Script text without comments, indentation, empty lines and runs of blanks, so that equal content hashes alike."""
    swap = lambda x, a, b: F.replace(x, F.lit(a), F.lit(b))
    words = lambda line: F.filter(F.split(F.translate(F.substring_index(line, "#", 1), "\t", " "), " "), lambda w: w != "")
    lines = F.transform(F.split(swap(swap(text, "\r\n", "\n"), "\r", "\n"), "\n"), lambda x: F.array_join(words(x), " "))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")
