"""Text rules: prompts, hashes, classification by name, path and content."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Lens names (fixed values). Their instruction texts are the caller's.
LENSES = ("structural", "semantic", "behavioral")
#: Class name patterns and the node type they give, first match first (fixed values).
NODE_TYPES = (
    ("Controller$", "CONTROLLER"),
    ("(Service|ServiceImpl)$", "SERVICE"),
    ("(Repository|Repo)$", "REPOSITORY"),
    ("Entity$", "ENTITY"),
    ("(Config|Configuration)$", "CONFIG"),
    ("Security", "SECURITY"),
    ("(DTO|Request|Response)$", "DTO"),
    ("(Test|Tests)$", "TEST"),
)
#: Marks of behavior in code, any of which gives the line (fixed values); None: how often errors are handled.
BEHAVIORS = (
    (("@Transactional",), "Transaction boundary: @Transactional present"),
    (("enum", "Status"), "State machine: Status enum detected"),
    (None, "Error handling: {} try blocks, {} catch blocks"),
    (("@Async", "CompletableFuture"), "Async: Asynchronous execution present"),
    (("@Retry", "@Retryable"), "Retry: Retry logic configured"),
    ((".save(", ".delete("), "Side effects: Database write operations"),
    (("RestTemplate", "WebClient"), "Side effects: External HTTP calls"),
)
#: Words that go with an entity type (fixed values).
ENTITY_WORDS = {
    "STATE_MACHINE": "controller endpoint api rest",
    "CONFIG_STATE": "configuration settings properties",
    "SECURITY_LAYER": "security authentication authorization",
    "FILE_REGISTRY": "service repository business logic",
    "DIAGNOSTIC_ENGINE": "test error exception debug",
    "TEMPORAL_CONTEXT": "schedule timer async cron",
}
#: Priority of a node type in the queue (fixed values).
PRIORITIES = {"CONTROLLER": 1, "SERVICE": 2, "REPOSITORY": 3, "ENTITY": 4}


def instruct(text: Column, instruction: Column) -> Column:
    """Instruction line and query line; the bare text where there is no instruction."""
    return F.when(instruction.isNull() | (instruction == ""), text).otherwise(F.concat(F.lit("Instruct: "), instruction, F.lit("\nQuery: "), text))


#: The instruction of a prompt that has none of its own (fixed value).
INSTRUCTION = "Given a web search query, retrieve relevant passages that answer the query"


def rerank_prompt(query: Column, document: Column, instruction: Column | None = None) -> Column:
    """Three lines; INSTRUCTION where none is given, or a null one."""
    instruction = F.lit(INSTRUCTION) if instruction is None else F.coalesce(instruction, F.lit(INSTRUCTION))
    return F.concat(F.lit("<Instruct>: "), instruction, F.lit("\n<Query>: "), query, F.lit("\n<Document>: "), document)


def short_hash(text: Column) -> Column:
    """The first eight hexadecimal digits of the SHA-256."""
    return F.substring(F.sha2(text.cast("binary"), 256), 1, 8)


def content_hash(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def cache_key(text: Column, lens: Column, dim: int) -> Column:
    """Key of a cached embedding: the text's MD5, with the lens and the width, which both change the vector."""
    return F.concat_ws(":", F.md5(text.cast("binary")), lens, F.lit(str(dim)))


def node_type(name: Column, content: Column | None = None) -> Column:
    """By a class or Java file name, with @Entity in the content as a mark of an entity; UTIL if nothing fits."""
    name = F.regexp_replace(name, r"\.java$", "")
    out = None
    for pattern, kind in NODE_TYPES:
        hit = name.rlike(pattern)
        if kind == "ENTITY" and content is not None:
            hit = hit | F.coalesce(content.contains("@Entity"), F.lit(False))
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out.otherwise("UTIL")


def priority(kind: Column) -> Column:
    out = None
    for name, p in PRIORITIES.items():
        out = F.when(kind == name, p) if out is None else out.when(kind == name, p)
    return out.otherwise(5)


def first_match(rules: list[tuple[Column, str, str, float]]) -> tuple[Column, Column]:
    """Label and confidence of the first rule (column, regular expression, label, confidence) that matches."""
    label = confidence = None
    for column, pattern, name, sure in rules:
        hit = column.rlike(pattern)
        label = F.when(hit, name) if label is None else label.when(hit, name)
        confidence = F.when(hit, sure) if confidence is None else confidence.when(hit, sure)
    return label, confidence


def phased(phases: list[list[tuple[Column, str, str, float]]]) -> tuple[Column, Column]:
    """Label and confidence over phases of rules: in each the first rule that matches, and a later phase overrides an earlier one."""
    found = [first_match(rules) for rules in phases[::-1]]
    return F.coalesce(*[label for label, _ in found]), F.coalesce(*[sure for _, sure in found])


def indexed(is_class: Column, is_interface: Column, is_public: Column, lines: Column, is_configuration: Column, annotations: Column, complexity: Column) -> Column:
    """Whether an element becomes a node: any of six conditions (fixed values); a null counts as not met."""
    marks = F.array(*[F.lit(x) for x in ("@Service", "@Controller", "@Component")])
    conditions = [is_class, is_interface, is_public & (lines > 20), is_configuration, F.arrays_overlap(annotations, marks), complexity > 10]
    met = F.coalesce(conditions[0], F.lit(False))
    for c in conditions[1:]:
        met = met | F.coalesce(c, F.lit(False))
    return met


def cut_words(text: Column, length: int, prefix: str, suffix: str) -> Column:
    """prefix, the text's leading words and suffix, `length` words in all; the text alone is cut, to none if need be."""
    room = max(0, length - len(prefix.split()) - len(suffix.split()))
    words = F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " ")
    return F.concat_ws(" ", F.lit(prefix), F.nullif(F.array_join(F.slice(words, 1, room), " "), F.lit("")) if room else F.lit(None).cast("string"), F.lit(suffix))


def domain(package: Column) -> Column:
    """Third part of a package under com., else the first part of a dotted one, else core."""
    parts = F.split(package, r"\.")
    return F.when(package.startswith("com."), F.coalesce(F.get(parts, F.lit(2)), F.lit("core"))).when(package.contains("."), F.get(parts, F.lit(0))).otherwise("core")


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def relative_path(path: Column, root: str) -> Column:
    """The path below `root`, without a leading slash; the path itself if it lies elsewhere; `.` for the root."""
    top = root.rstrip("/")
    return F.when(path == top, ".").when(path.startswith(f"{top}/"), F.ltrim(F.substring(path, F.lit(len(top) + 1), F.length(path)), F.lit("/"))).otherwise(path)


def behavior(text: Column) -> Column:
    """One line for each mark of behavior that a text holds; both words make the state machine."""
    lines = []
    for marks, line in BEHAVIORS:
        if marks is None:
            tries, catches = F.regexp_count(text, F.lit(r"try \{|try\{")), F.regexp_count(text, F.lit(r"catch \(|catch\("))
            lines.append(F.when(tries > 0, F.concat(F.lit("- "), F.format_string(line.replace("{}", "%d"), tries, catches))))
            continue
        hits = [text.contains(m) for m in marks]
        hit = hits[0]
        for h in hits[1:]:
            hit = (hit & h) if marks == ("enum", "Status") else (hit | h)
        lines.append(F.when(hit, F.lit(f"- {line}")))
    return F.concat_ws("\n", *lines)


def behavioral_context(name: Column, text: Column) -> Column:
    """Heading and lines of behavior(): the input of the behavioral lens."""
    return F.concat(F.lit("Runtime Analysis for "), name, F.lit(":\n"), behavior(text))


def structural_context(node: dict[str, Column], sources: Column, targets: Column, types: Column) -> Column:
    """A node's place in the graph as text, the input of the structural lens; types is an array.

    Figures have four and six decimals; exact halves are rounded up.
    """
    fixed = lambda c, n: F.format_string(f"%.{n}f", c.cast("double"))
    lines = [
        F.concat(F.lit("Node: "), node["name"]),
        F.concat(F.lit("Node Type: "), node["node_type"]),
        F.concat(F.lit("Entity Type: "), node["entity_type"]),
        F.lit("\nGraph Properties:"),
        F.concat(F.lit("- In-Degree: "), node["in_degree"].cast("string")),
        F.concat(F.lit("- Out-Degree: "), node["out_degree"].cast("string")),
        F.concat(F.lit("- Betweenness Centrality: "), fixed(node["betweenness"], 4)),
        F.concat(F.lit("- PageRank: "), fixed(node["pagerank"], 6)),
        F.concat(F.lit("- Community: "), node["community"].cast("string")),
        F.lit("\nHyperedge Participation:"),
        F.concat(F.lit("- As Source: "), sources.cast("string"), F.lit(" hyperedges")),
        F.concat(F.lit("- As Target: "), targets.cast("string"), F.lit(" hyperedges")),
        F.concat(F.lit("- Types: ["), F.array_join(F.transform(F.array_sort(F.array_distinct(types)), lambda t: F.concat(F.lit("'"), t, F.lit("'"))), ", "), F.lit("]")),
    ]
    return F.concat_ws("\n", *lines)


def entity_text(name: Column, entity: Column) -> Column:
    """Name, entity type and the words that go with it."""
    words = None
    for kind, text in ENTITY_WORDS.items():
        words = F.when(entity == kind, text) if words is None else words.when(entity == kind, text)
    return F.concat(name, F.lit(" "), entity, F.lit(" "), words.otherwise(""))


def surest(rules: list[tuple[Column, str, float]]) -> Column:
    """(label, confidence) of the most confident rule (condition, label, confidence) that holds, the first of equal ones; null if none."""
    out = None
    for hit, label, sure in sorted(rules, key=lambda r: -r[2]):
        one = F.struct(F.lit(label).alias("label"), F.lit(float(sure)).alias("confidence"))
        out = F.when(hit, one) if out is None else out.when(hit, one)
    return out


def context(*pieces: Column) -> Column:
    """Pieces with a blank line between; nulls are skipped."""
    return F.concat_ws("\n\n", *pieces)
