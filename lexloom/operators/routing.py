"""Query routing by decision tables (RTE-*): rules are data, tried by priority; the first that matches wins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Routes of a query (fixed values).
ROUTES = ("metadata", "section", "factoid", "complex", "cache")

#: (route, pattern over a normalised query), by priority.
RULES: tuple[tuple[str, str], ...] = (
    ("section", r"\b(section|chapter|article|clause)\s+\d+(\.\d+)*\b"),
    ("metadata", r"\bhow many\s+(documents|files|pages|chunks)\b"),
    ("metadata", r"\b(list|show)\s+(all\s+)?(documents|files|members)\b"),
    ("metadata", r"\b(latest|newest|oldest|first)\s+(document|file)s?\b"),
    ("metadata", r"\bwho\s+(owns|uploaded)\b"),
    ("factoid", r"^(what|when|where|who|which)\s+(is|are|was|were)\b"),
)
#: Own patterns of questions about whole documents and contracts, over English text.
CONTRACT = (r"\b(parties|obligations|terms)\s+(of|in)\s+(the\s+)?(contract|agreement)\b", r"\bterminat\w+\b.*\b(contract|agreement)\b")
OVERVIEW = (r"\b(summar\w+|overview|gist|synopsis)\b", r"\babout\b.*\b(document|file|report|paper)s?\b", r"\b(key|main|central) (idea|point|topic|theme)s?\b")
FILE_WORDS = {"pdf": "pdf", "docx": r"docx?|word", "xlsx": r"xlsx?|excel", "pptx": r"pptx?|powerpoint", "txt": r"txt|text file"}
MULTI_HOP = r"\b(relationship|connection|compare|versus|vs|between|depends on|related to)\b"


def route(normalized: Column, rules=RULES, default: str = "complex") -> Column:
    """RTE-03, RTE-05, RTE-06. Route of a normalised query; an empty one takes the default."""
    out = F.when(normalized == "", default)
    for name, pattern in rules:
        out = out.when(normalized.rlike(pattern), name)
    return out.otherwise(default)


def intent(folded: Column) -> Column:
    """RTE-14. contract before overview before focused."""
    out = F.when(F.lit(False), "")
    for name, patterns in (("contract", CONTRACT), ("overview", OVERVIEW)):
        for pattern in patterns:
            out = out.when(folded.rlike(pattern), name)
    return out.otherwise("focused")


def mentioned_file_type(normalized: Column) -> Column:
    """RTE-08."""
    out = F.when(F.lit(False), "")
    for name, words in FILE_WORDS.items():
        out = out.when(normalized.rlike(rf"\b({words})\b"), name)
    return out


def decide_agent(normalized: Column, n_documents: Column) -> Column:
    """RTE-15, RTE-16. Structured questions before multi-hop ones before a rewrite."""
    structured = normalized.rlike(r"\b(count|total|average|sum|how many|list)\b")
    return F.when(structured, "sql").when(normalized.rlike(MULTI_HOP) | (n_documents >= 3), "graph").otherwise("rewrite")


def heading_score(title: Column, number: Column, wanted_title: Column, wanted_number: Column) -> Column:
    """RTE-10, TOP-10. 1 for number and title, then number, title, prefix and containment."""
    same_number = (wanted_number != "") & (number == wanted_number)
    same_title = (wanted_title != "") & (title == wanted_title)
    return (
        F.when(same_number & same_title, 1.0).when(same_number, 0.98).when(same_title, 0.95)
        .when((wanted_title != "") & title.startswith(wanted_title), 0.88).when((wanted_title != "") & title.contains(wanted_title), 0.70)
        .otherwise(0.0)
    )


def max_calls_violated(route_type: Column, calls: Column, most: int = 1) -> Column:
    """FLT-22. More calls than a route may make."""
    return calls > F.when(route_type == "complex", most).otherwise(0)


def cost_usd(tokens_in: Column, tokens_out: Column, rate_in: float, rate_out: float) -> Column:
    """FN-22. Rates are dollars a million tokens."""
    return F.round((tokens_in * rate_in + tokens_out * rate_out) / 1e6, 8)
