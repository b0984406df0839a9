"""Text and parsing functions as Column expressions: normalisation, tokens, actions, goals, families, prompts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word lists and vocabularies that decide results.
ACTION_STOPWORDS = ("a", "an", "and", "at", "from", "go", "in", "into", "is", "of", "on", "put", "take", "the", "to", "use", "with")
TOKEN_STOPWORDS = ("a", "an", "and", "are", "at", "do", "for", "from", "in", "is", "it", "of", "on", "or", "put", "the", "to", "two", "with", "you")
TREATMENT_TOOLS = {"clean": "sinkbasin", "cool": "fridge", "heat": "microwave"}
COUNT_WORDS = {
    "both": 2, "once": 1, "one": 1, "twice": 2, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7,
    "eight": 8, "nine": 9, "ten": 10, "eleven": 11, "twelve": 12,
}
COUNT_TOKEN = r"(?:\d+|both|once|one|twice|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve)"
META_ACTIONS = ("help", "inventory", "look")
GOAL_MARKER = "your task is to:"
OUTPUT_PREFIXES = ("Action:", "action:", "Next action:", "next action:", "Answer:", "answer:")
#: schema, pattern over the normalised action, meaning of its groups; the first that fits counts.
ACTION_PATTERNS = (
    ("take_from", r"^take (.+?) from (.+)$", ("object", "source")),
    ("move_to", r"^move (.+?) to (.+)$", ("object", "target")),
    ("go_to", r"^go to (.+)$", ("target",)),
    ("treatment", r"^(clean|cool|heat) (.+?) with (.+)$", ("verb", "object", "tool")),
    ("use_with", r"^use (.+?) with (.+)$", ("object", "tool")),
    ("open", r"^open (.+)$", ("object",)),
    ("close", r"^close (.+)$", ("object",)),
)
ENTITY_PATTERNS = (("examine", r"^examine (.*)$", ("object",)), ("use", r"^use (.*)$", ("object",)))
ACTION_FIELDS = ("verb", "object", "source", "target", "tool")
ARTICLE = r"(?:a |an |the |some )?"
#: Goal patterns by dialect, in order; group 1 is the object, group 2 the destination.
GOAL_PATTERNS = {
    "strict": (
        rf"(?:examine|look at)\s+{ARTICLE}([a-z]+)",
        r"(?:put|place)\s+two\s+([a-z]+)\s+(?:in|on)\s+([a-z]+)",
        r"(?:find\s+)?two\s+([a-z]+)\s+and\s+put\s+(?:them|it)\s+(?:in|on)\s+([a-z]+)",
        rf"(?:clean|heat|cool)\s+{ARTICLE}([a-z]+)\s+and\s+put\s+it\s+(?:in|on)\s+([a-z]+)",
        rf"(?:put|place)\s+{ARTICLE}(?:clean |cool |hot |heated |cooled |cleaned )?([a-z]+)\s+(?:in|on)\s+([a-z]+)",
    ),
    "lenient": (
        rf"(?:examine|look at)\s+{ARTICLE}([a-z]+)",
        rf"(?:put|place)\s+two\s+([a-z]+)\s+(?:in|on)\s+{ARTICLE}([a-z]+)",
        rf"(?:find\s+)?two\s+([a-z]+)\s+and\s+put\s+(?:them|it)\s+(?:in|on)\s+{ARTICLE}([a-z]+)",
        rf"(?:clean|heat|cool)\s+{ARTICLE}([a-z]+)\s+and\s+put\s+it\s+(?:in|on)\s+{ARTICLE}([a-z]+)",
        rf"(?:put|place)\s+{ARTICLE}(?:clean |cleaned |cold |cool |cooled |chilled |hot |heated )?([a-z]+)\s+(?:in|on)\s+{ARTICLE}([a-z]+)",
    ),
}
TREATMENT_WORDS = {
    "strict": (("clean", r"\b(clean|cleaned)\b"), ("cool", r"\b(cool|cooled)\b"), ("heat", r"\b(hot|heat|heated)\b")),
    "lenient": (("clean", r"\b(clean|cleaned)\b"), ("cool", r"\b(cold|cool|cooled|chilled)\b"), ("heat", r"\b(hot|heat|heated)\b")),
}

#: Goals that offer a choice or an upper bound, and so ask for one thing.
CHOICES = (
    rf"\b(?:one|1)\s+of\s+(?:the\s+)?{COUNT_TOKEN}\b",
    rf"\b(?:choose|select)\s+(?:one|1)\b.*\b(?:from|among|of)\s+(?:the\s+)?{COUNT_TOKEN}\b",
    rf"\b(?:at most|no more than|up to)\s+{COUNT_TOKEN}\b",
    r"\b(?:one|1)\s+or\s+(?:two|2)\b",
)
#: Task families by the words that name them, in order, for the budget sampler and for the evaluator; the last is for all others.
FAMILIES = {
    "budget": (
        ("pick_two_obj_and_place", ("find two", "put two")), ("pick_clean_then_place_in_recep", ("clean",)), ("pick_heat_then_place_in_recep", ("heat",)),
        ("pick_cool_then_place_in_recep", ("cool",)), ("look_at_obj_in_light", ("look at", "desklamp", "floorlamp")), ("pick_and_place_simple", ("",)),
    ),
    "prompt": (
        ("look_at_obj_in_light", ("desklamp", "desk lamp")), ("pick_two_obj_and_place", ("two ",)), ("pick_clean_then_place_in_recep", ("clean", "wash")),
        ("pick_cool_then_place_in_recep", ("cool", "chill")), ("pick_heat_then_place_in_recep", ("heat", "warm")), ("pick_and_place_simple", ("",)),
    ),
}
#: Sections of a prompt: the text between a head and the next.
SECTIONS = {
    "instruction": r"(?s)Task instruction:\n(.*?)(?:\n\nPrevious actions:|$)",
    "previous": r"(?s)Previous actions:\n(.*?)(?:\n\nCurrent observation:|$)",
    "observation": r"(?s)Current observation:\n(.*?)(?:\n\nCandidate action:|\n\nReturn the next action only\.|$)",
    "candidate": r"(?s)Candidate action:\n(.*?)(?:\n\nJudge whether|$)",
}
#: A contract violation record: blocked action, what it requires, version, required action.
CONTRACT_RECORD = r"(?i)Contract violation record:\s*(.+?)\s+requires\s+(.+?)\s+under\s+([a-zA-Z0-9_]+)\.\s+Required action:\s+(.+?)\."


def col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def normalize(text: str | Column) -> Column:
    """Lower case, trimmed, single blanks; null is empty."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(col(text), F.lit(""))), r"\s+", " "))


def word_tokens(text: str | Column) -> Column:
    """Alphabetic words without the action stop-words; order and repeats stay."""
    words = F.regexp_extract_all(F.lower(F.coalesce(col(text), F.lit(""))), F.lit("[a-z]+"), F.lit(0))
    return F.filter(words, lambda w: ~w.isin(*ACTION_STOPWORDS))


def id_tokens(text: str | Column) -> Column:
    """Distinct identifier tokens of more than one character, digits blanked."""
    blanked = F.regexp_replace(F.lower(F.coalesce(col(text), F.lit(""))), r"\d+", " ")
    return F.filter(F.array_distinct(F.regexp_extract_all(blanked, F.lit("[a-z][a-z0-9_-]*"), F.lit(0))), lambda w: ~w.isin(*TOKEN_STOPWORDS) & (F.length(w) > 1))


def raw_tokens(text: str | Column, remove_periods: bool = False) -> Column:
    """Distinct pieces between white space."""
    norm = normalize(text)
    norm = F.replace(norm, F.lit("."), F.lit("")) if remove_periods else norm
    return F.array_distinct(F.filter(F.split(norm, " "), lambda w: w != ""))


def entity_base(entity: str | Column) -> Column:
    """Without the trailing index."""
    return F.regexp_replace(normalize(entity), r"\s+\d+$", "")


def drop_last_word(entity: str | Column) -> Column:
    """Without the last word, number or not; a single word stays."""
    norm = normalize(entity)
    return F.when(F.instr(norm, " ") > 0, F.regexp_replace(norm, r" [^ ]*$", "")).otherwise(norm)


def action_verb(action: str | Column) -> Column:
    first = F.substring_index(normalize(action), " ", 1)
    return F.when(first == "", "empty").otherwise(first)


def parse_action(action: str | Column, entities: bool = False) -> Column:
    """struct(schema, verb, object, source, target, tool), missing parts empty. entities: examine and use are schemas too."""
    norm = normalize(action)
    verb = action_verb(action)

    def parsed(schema: str, pattern: str, groups: tuple[str, ...]) -> Column:
        parts = {g: F.regexp_extract(norm, pattern, i + 1) for i, g in enumerate(groups)}
        parts.setdefault("verb", verb)
        return F.struct(F.lit(schema).alias("schema"), *[F.trim(parts[f]).alias(f) if f in parts else F.lit("").alias(f) for f in ACTION_FIELDS])

    other = F.struct(F.lit("other").alias("schema"), verb.alias("verb"), norm.alias("object"), *[F.lit("").alias(f) for f in ACTION_FIELDS[2:]])
    out = other
    for schema, pattern, groups in reversed(ACTION_PATTERNS + (ENTITY_PATTERNS if entities else ())):
        out = F.when(norm.rlike(pattern), parsed(schema, pattern, groups)).otherwise(out)
    return out


def matched(action: str | Column, schema: str, group: str) -> Column:
    """A part of an action of the given schema, null for others."""
    pattern, groups = {**{s: (p, g) for s, p, g in ACTION_PATTERNS}, "examine": (r"^examine (.+)$", ("object",))}[schema]
    return F.nullif(F.regexp_extract(normalize(action), pattern, groups.index(group) + 1), F.lit(""))


def task_goal(instruction: str | Column) -> Column:
    """What follows the marker, or all."""
    text = F.coalesce(col(instruction), F.lit(""))
    at = F.locate(GOAL_MARKER, F.lower(text))
    return F.when(at > 0, F.trim(F.substring(text, at + F.lit(len(GOAL_MARKER)), F.length(text)))).otherwise(text)


def goal_text(instruction: str | Column) -> Column:
    return F.lower(F.regexp_replace(F.trim(task_goal(instruction)), r"\.+$", ""))


def required_count(goal: str | Column) -> Column:
    """The first number word above 1, unless a choice or an upper bound is meant; else 1."""
    norm = normalize(goal)
    table = F.create_map(*[F.lit(x) for pair in COUNT_WORDS.items() for x in pair])
    found = F.transform(F.regexp_extract_all(norm, F.lit(rf"\b{COUNT_TOKEN}\b"), F.lit(0)), lambda t: F.coalesce(F.try_element_at(table, t), t.try_cast("int"), F.lit(1)))
    first = F.coalesce(F.try_element_at(F.filter(found, lambda n: n > 1), F.lit(1)), F.lit(1))
    chosen = F.lit(False)
    for p in CHOICES:
        chosen = chosen | norm.rlike(p)
    return F.when(chosen, 1).otherwise(first).cast("long")


def parse_goal(instruction: str | Column, dialect: str = "lenient") -> Column:
    """struct(object, destination, treatment, count, needs_light). Strict and lenient differ in articles before the destination, word forms and counts."""
    goal = goal_text(instruction)
    obj, dest = F.lit(""), F.lit("")
    for pattern in reversed(GOAL_PATTERNS[dialect]):
        hit = goal.rlike(pattern)
        obj = F.when(hit, F.regexp_extract(goal, pattern, 1)).otherwise(obj)
        dest = F.when(hit, F.regexp_extract(goal, pattern, 2) if pattern.count("([a-z]+)") > 1 else F.lit("")).otherwise(dest)
    treatment = F.lit("")
    for name, pattern in reversed(TREATMENT_WORDS[dialect]):
        treatment = F.when(goal.rlike(pattern), name).otherwise(treatment)
    count = required_count(goal) if dialect == "strict" else F.when(goal.rlike(r"\b(two|2)\b"), 2).otherwise(1).cast("long")
    return F.struct(obj.alias("object"), dest.alias("destination"), treatment.alias("treatment"), count.alias("count"), goal.contains("lamp").alias("needs_light"))


def family(instruction: str | Column, dialect: str) -> Column:
    """The first of the dialect's task families of which a word occurs."""
    t = F.lower(F.coalesce(col(instruction), F.lit("")))
    *named, (rest, _) = FAMILIES[dialect]
    out = F.lit(rest)
    for name, words in reversed(named):
        out = F.when(t.rlike("|".join(words)), name).otherwise(out)
    return out


def family_budget(instruction: str | Column) -> Column:
    """Task family as the budget sampler names it: two objects first, lamps late."""
    return family(instruction, "budget")


def family_prompt(instruction: str | Column) -> Column:
    """Task family as the evaluator names it: lamps first, any ``two``."""
    return family(instruction, "prompt")


def visible_entities(observation: str | Column) -> Column:
    """Distinct names with a number, normalised."""
    found = F.regexp_extract_all(F.coalesce(col(observation), F.lit("")), F.lit(r"(?i)\b([a-z][a-z0-9]*(?: [a-z][a-z0-9]*)? \d+)\b"), F.lit(1))
    return F.array_distinct(F.transform(found, normalize))


def arrival_location(observation: str | Column) -> Column:
    return F.nullif(F.trim(F.regexp_extract(normalize(observation), r"^you arrive at ([^.]*)", 1)), F.lit(""))


def prompt_section(prompt: str | Column, section: str) -> Column:
    """instruction, previous, observation or candidate of a prompt, trimmed; empty if absent."""
    return F.trim(F.regexp_extract(F.coalesce(col(prompt), F.lit("")), SECTIONS[section], 1))


def contract_records(text: str | Column) -> Column:
    """Array of struct(blocked_action, required_action, version) of all contract violation records."""
    group = lambda i: F.regexp_extract_all(F.coalesce(col(text), F.lit("")), F.lit(CONTRACT_RECORD), F.lit(i))
    zipped = F.arrays_zip(group(1).alias("blocked"), group(4).alias("required"), group(3).alias("version"))
    return F.transform(zipped, lambda r: F.struct(normalize(r["blocked"]).alias("blocked_action"), normalize(r["required"]).alias("required_action"), normalize(r["version"]).alias("version")))


def clean_output(text: str | Column) -> Column:
    """A model's next action: without reasoning block, first line, prefix and quotes off."""
    bare = F.trim(F.regexp_replace(F.coalesce(col(text), F.lit("")), r"(?is)<think>.*?</think>", ""))
    lines = F.filter(F.transform(F.split(bare, r"\r\n|[\n\r]"), lambda s: F.trim(s)), lambda s: s != "")
    first = F.coalesce(F.try_element_at(lines, F.lit(1)), F.lit(""))
    stripped = F.trim(F.regexp_replace(first, "^(?:" + "|".join(OUTPUT_PREFIXES) + ")", ""))
    quoted = stripped.rlike(r"""^(?:".*"|'.*')$""") & (F.length(stripped) > 1)
    return F.when(quoted, F.trim(F.substring(stripped, F.lit(2), F.length(stripped) - 2))).otherwise(stripped)


def task_identity(task: str | Column, prefix: str = "alfworld/") -> Column:
    """An id without its namespace."""
    return F.when(col(task).startswith(prefix), F.substring_index(col(task), "/", -1)).otherwise(col(task))


def action_key(name: str | Column, args: str | Column) -> Column:
    """name(k=v,...) with sorted arguments; args is a map."""
    entries = F.array_sort(F.map_entries(col(args)))
    return F.concat(col(name), F.lit("("), F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ","), F.lit(")"))


def difficulty(steps: str | Column) -> Column:
    return F.when(col(steps) <= 10, "short").when(col(steps) <= 22, "medium").otherwise("long")


def feature_group(name: str | Column) -> Column:
    """Reporting group of a feature by its name."""
    n = col(name)
    starts = lambda *p: n.rlike("^(?:" + "|".join(p) + ")")
    search = ("candidate:novel_location", "candidate:repeats", "candidate:visited_location", "sem:action_repeats_recent", "sem:go_to_new_location", "sem:go_to_visited_location")
    return (
        F.when(starts("object:", "target:"), "Entity context")
        .when(starts("delta:", "sem:delta:", "sem:effect:"), "Verified effects")
        .when(starts("schema:", "verb:", "sem:schema:", "sem:verb:"), "Action schema")
        .when(starts("search:", "lex:recent", "lex:observation", "lex:raw_recent", "lex:raw_observation") | n.isin(*search), "Search/history")
        .when(starts("candidate:matches", "sem:action_"), "Goal/entity alignment")
        .when(starts("lex:"), "Lexical context")
        .otherwise("Other")
    )


# Names of features in reports that their own names don't give.
DISPLAY_NAMES = {
    "delta:holding_target": "holding target", "schema:close": "close action", "delta:target_acquired": "target acquired", "delta:opened": "opened state", "schema:open": "open action",
    "delta:target_treated": "target treated", "schema:use": "use action", "lex:observation_jaccard": "observation overlap", "candidate:matches_goal": "goal match", "delta:treated": "treatment effect",
}


def display_name(name: str | Column) -> Column:
    """A feature's name in reports: a fixed one, for bindings thing and place, else with blanks for colons."""
    n = col(name)
    fixed = F.create_map(*[F.lit(x) for pair in DISPLAY_NAMES.items() for x in pair])
    bound = F.regexp_replace(F.regexp_replace(n, r"^sem:bind:|goal_object=|treatment=", ""), r"\|location=", " @ ")
    return F.coalesce(F.try_element_at(fixed, n), F.when(n.startswith("sem:bind:"), bound).otherwise(F.replace(n, F.lit(":"), F.lit(" "))))


def normal_path(path: str | Column) -> Column:
    """Without empty parts, dots, and parts that a following ``..`` takes back."""
    root = F.when(col(path).startswith("/"), "/").otherwise("")
    step = lambda out, x: F.when((x == "..") & (F.size(out) > 0) & (F.try_element_at(out, F.lit(-1)) != ".."), F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0)))).otherwise(F.array_append(out, x))
    parts = F.filter(F.split(col(path), "/"), lambda x: ~x.isin("", "."))
    return F.concat(root, F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/"))


def resolve_link(base: str | Column, link: str | Column) -> Column:
    """A link in a configuration file, relative to the file's folder; absolute paths and addresses stay."""
    fixed = col(link).startswith("/") | F.contains(col(link), F.lit("://"))
    return F.when(fixed, col(link)).otherwise(normal_path(F.concat(F.regexp_extract(col(base), r"^(.*/)?[^/]*$", 1), col(link))))


def portable_path(path: str | Column, root: str) -> Column:
    """Relative to the root for what lies below it, so that a record outlives a move of the root."""
    norm, top = normal_path(path), root.rstrip("/") + "/"
    return F.when(norm.startswith(top), F.substring(norm, F.lit(len(top) + 1), F.length(norm))).otherwise(col(path))


def invalid_release_path(path: str | Column) -> Column:
    """Whether a path may not stand in a release's list: empty, absolute, not in normal form, or with a backslash or colon."""
    p = col(path)
    return (p == "") | p.startswith("/") | p.rlike(r"[\\\\:]|(^|/)\.\.?(/|$)|//|/$")


def json_value(value: str | Column) -> Column:
    """Compact JSON of a string, number or array."""
    text = F.to_json(F.array(col(value)))
    return F.substring(text, F.lit(2), F.length(text) - 2)


def canonical_key(*values: str | Column) -> Column:
    """A compact JSON list of the values, as a key."""
    return F.concat(F.lit("["), F.concat_ws(",", *map(json_value, values)), F.lit("]"))
