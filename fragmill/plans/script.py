"""Query scripts: a gate for written queries, and the text of a plan in the same language.

A script is Python without imports, definitions, attributes but a few, or
names with two underscores; its ``answer`` must be a fragment.  Its own lines
are counted against a budget while it runs.
"""

from __future__ import annotations

import ast
import sys
from types import FrameType

from fragmill.model import Context
from fragmill.operators import graph as G
from fragmill.operators import select as S
from fragmill.operators.frag import Frag, eval_unit
from fragmill.operators.intent import intent
from fragmill.operators.units import Annotation, Lexical, Modifier, QueryUnit, Term
from fragmill.plans.planner import Boost, Cohere, EvalUnit, Filter, Intent, Narrow, Plan

MAX_LINES, STEP_BUDGET = 200, 200_000
_FORBIDDEN = (ast.Import, ast.ImportFrom, ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef, ast.Lambda, ast.Global, ast.Nonlocal, ast.Try, ast.With, ast.AsyncWith, ast.AsyncFor, ast.Await, ast.Yield, ast.YieldFrom, ast.Delete)
_ATTRIBUTES = {"induced", "roots", "leaves", "only_nodes", "append", "items", "keys", "values", "lower", "upper", "startswith", "endswith"}
_BUILTINS = {"len": len, "min": min, "max": max, "sum": sum, "sorted": sorted, "range": range, "list": list, "dict": dict, "set": set, "tuple": tuple, "enumerate": enumerate, "zip": zip, "any": any, "all": all, "abs": abs, "round": round, "str": str, "int": int, "float": float, "bool": bool, "True": True, "False": False, "None": None}


class ScriptError(ValueError):
    pass


def check(text: str) -> ast.Module:
    """The parsed script, if it stays within the gate."""
    if text.count("\n") > MAX_LINES:
        raise ScriptError(f"more than {MAX_LINES} lines")
    try:
        tree = ast.parse(text)
    except SyntaxError as e:
        raise ScriptError(f"line {e.lineno}: {e.msg}") from None
    for node in ast.walk(tree):
        if isinstance(node, _FORBIDDEN):
            raise ScriptError(f"line {node.lineno}: {type(node).__name__} is not allowed")
        if isinstance(node, ast.Attribute) and node.attr not in _ATTRIBUTES:
            raise ScriptError(f"line {node.lineno}: no attribute {node.attr!r}")
        if isinstance(node, ast.Name) and node.id.startswith("__"):
            raise ScriptError(f"line {node.lineno}: no name {node.id!r}")
    return tree


def namespace(ctx: Context, judged: bool = False) -> dict[str, object]:
    """What a script may call; without ``judged`` the intent filter lets everything pass."""
    return {
        "term": Term,
        "lexical": Lexical,
        "annotation": Annotation,
        "modifier": Modifier,
        "unit": lambda name, *satisfiers, combine="noisy_or": QueryUnit(name, satisfiers, combine),
        "eval_unit": lambda unit: eval_unit(unit, ctx, settle=True),
        "reach": lambda src, **o: G.reach(src, ctx, **o),
        "hop": lambda src, dst, **o: G.hop(src, dst, ctx, **o),
        "degree": lambda frag, **o: S.degree(frag, ctx, **o),
        "only": lambda frag, *, kind=None, file=None, language=None: S.only(frag, kind=kind, file=file, language=language),
        "top": S.top,
        "boosted_top": lambda frag, n, near=None, kinds=(): frag.induced(S.top_ids(S.boosted_scores(frag, near and near.nodes, kinds), n).select("symbol_id")),
        "intent": (lambda frag, concept, **o: intent(frag, concept, ctx, **o)) if judged else (lambda frag, concept, **o: frag),
    }


def run_script(text: str, ctx: Context, *, budget: int = STEP_BUDGET, judged: bool = False) -> Frag:
    code = compile(check(text), "<script>", "exec")
    names: dict[str, object] = {"__builtins__": _BUILTINS, **namespace(ctx, judged)}
    left = budget

    def watch(frame: FrameType, event: str, _: object):
        nonlocal left
        if frame.f_code.co_filename != "<script>":
            return None
        if event == "line":
            left -= 1
            if left < 0:
                raise ScriptError("the script runs too long")
        return watch

    before = sys.gettrace()
    sys.settrace(watch)
    try:
        exec(code, names)  # noqa: S102  behind the gate above
    finally:
        sys.settrace(before)
    answer = names.get("answer")
    if not isinstance(answer, Frag):
        raise ScriptError("the script leaves no fragment in 'answer'")
    return answer


def _satisfier(s: object) -> str:
    words = lambda values: repr([v.value if isinstance(v, Term) else v for v in values])
    if isinstance(s, Lexical):
        return f"lexical({words(s.terms)}, weight={s.weight!r}" + (f", fields={list(s.fields)!r}" if s.fields is not None else "") + ")"
    if isinstance(s, Annotation):
        return f"annotation({words(s.names)}, {words(s.terms)}, weight={s.weight!r})"
    if isinstance(s, Modifier):
        return f"modifier({words(s.modifiers)}, weight={s.weight!r})"
    raise TypeError(f"no text for {type(s).__name__}")


def to_script(plan: Plan) -> str:
    """The plan as a script that the gate accepts and that gives the same fragment."""
    lines, name, near = [], {}, False

    def boost(expression: str) -> None:
        nonlocal near
        lines.append(f"near = near | {expression}" if near else f"near = {expression}")
        near = True

    for step in plan.steps:
        if isinstance(step, EvalUnit):
            name[step.unit.name] = f"u{len(name)}"
            lines.append(f"{name[step.unit.name]} = eval_unit(unit({step.unit.name!r}, {', '.join(map(_satisfier, step.unit.satisfiers))}, combine={step.unit.combine!r}))")
            lines.append(f"current = {name[step.unit.name]}" if step.seed else f"current = current | {name[step.unit.name]}")
        elif isinstance(step, Filter):
            lines.append(f"current = current & {name[step.unit]}")
        elif isinstance(step, Boost):
            boost(f"reach({name[step.src]}, edge={list(step.edge)!r}, direction='any', hops={step.hops!r})")
        elif isinstance(step, Cohere):
            boost(f"reach(top(current, {step.seeds}), edge={list(step.edge)!r}, direction='any', hops={step.hops!r})")
        elif isinstance(step, Narrow):
            if step.limit:
                lines.append(f"current = boosted_top(current, {step.limit}, {'near' if near else 'None'}, {step.kinds!r})")
        elif isinstance(step, Intent):
            lines.append(f"current = intent(current, {step.concept!r}, max_items={step.most})")
    return "\n".join([*lines, "answer = current", ""])
