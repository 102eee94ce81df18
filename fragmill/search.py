"""Search: words to a ranked, explained answer, by the lexical, planned or scripted route."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame

from fragmill.model import Context
from fragmill.operators import select as S
from fragmill.operators.frag import Frag, eval_unit
from fragmill.operators.intent import intent
from fragmill.operators.units import Lexical, QueryUnit
from fragmill.plans.build import build_spec, known_terms
from fragmill.plans.planner import JUDGE_CAP, plan
from fragmill.plans.script import run_script

# Words that carry no intent yet appear in code.
STOP_WORDS = frozenset(
    [
        "a", "an", "the", "and", "or", "not", "of", "in", "on", "at", "to", "for", "from", "with", "by",
        "is", "are", "was", "were", "be", "been", "that", "this", "these", "those", "it", "its", "as", "if", "then", "than",
        "when", "where", "which", "who", "whom", "what", "how", "why", "do", "does", "did", "done",
        "can", "could", "should", "would", "will", "shall", "may", "might", "must",
    ]
)
QUERY_WORD = r"[A-Za-z][A-Za-z0-9]*"
NO_WORD = "no word in the query appears in this corpus's vocabulary"


@dataclass
class SearchResult:
    hits: DataFrame
    frag: Frag | None
    route: str
    notes: list[str] = field(default_factory=list)
    script: str = ""


def query_terms(query: str, ctx: Context) -> list[str]:
    """Words of the query outside the stop list that the vocabulary or the expansions know, in order."""
    words = [w.lower() for w in re.findall(QUERY_WORD, query)]
    return known_terms([w for w in words if len(w) >= 2 and w not in STOP_WORDS], ctx)


def lexical_unit(terms: Sequence[str], weight: float = 0.5) -> QueryUnit:
    return QueryUnit("query", (Lexical(list(terms), weight=weight),))


def hits_of(frag: Frag, limit: int, rank_by: str = "score", boosted: DataFrame | None = None) -> DataFrame:
    """Ranked rows with their reasons; by raw score, or by boosted score if asked."""
    scores = S.boosted_scores(frag, boosted) if rank_by == "boosted" else None
    return S.ranked(frag, limit, scores).join(S.reasons(frag), "symbol_id", "left").orderBy("rank")


def search(query: str, ctx: Context, *, route: str = "lexical", limit: int = 30, understand: Callable[[str, Context], dict] | None = None, script: Callable[[str, Context], str] | None = None, concept: str = "") -> SearchResult:
    """The route asked for, or the lexical one with a note if that fails or lacks its port.

    ``understand`` gives terms, groups, relations, annotations and a concept
    for the planned route; ``script`` gives the text of the scripted one.
    """
    notes: list[str] = []
    if route not in ("lexical", "planned", "script"):
        raise ValueError(f"unknown route {route!r}")
    try:
        if route == "script" and script is not None:
            text = script(query, ctx)
            frag = run_script(text, ctx)
            return SearchResult(hits_of(frag, limit), frag, route, notes, text)
        if route == "planned":
            known = understand(query, ctx) if understand else {"terms": query_terms(query, ctx)}
            spec, doubts = build_spec(query, known.pop("terms"), ctx, limit=limit, **known)
            frag = plan(spec, ctx).run(ctx).current
            return SearchResult(hits_of(frag, limit), frag, route, doubts)
    except (PySparkException, Py4JError):  # a job that failed is no answer
        raise
    except Exception as e:  # a port or a script that fails degrades to the lexical route, and says so
        notes.append(f"{route} route failed: {type(e).__name__}: {e}")
    if route != "lexical" and not notes:
        notes.append(f"no port for the {route} route")
    terms = query_terms(query, ctx)
    if not terms:
        empty = ctx.spark.createDataFrame([], "rank int, symbol_id long, name string, kind string, file string, score double, why string")
        return SearchResult(empty, None, "lexical", [*notes, NO_WORD])
    frag = eval_unit(lexical_unit(terms), ctx)
    if concept:
        frag = intent(S.top(frag, JUDGE_CAP), concept, ctx)
    return SearchResult(hits_of(frag, limit), frag, "lexical", notes)
