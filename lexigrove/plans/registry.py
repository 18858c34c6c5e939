"""Libraries of annotators, configurations made of their components, contexts that carry one, and running them."""

from __future__ import annotations

import logging
import threading
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrove.functions.arrays import settled
from lexigrove.operators import chains
from lexigrove.plans import components as c
from lexigrove.plans.components import Component

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class Library:
    """``run``: (df, component, text column) -> df. ``create`` and ``reset`` make and clear what it keeps in a context."""

    name: str
    constructors: dict[str, Callable[..., Component]]
    run: Callable[[DataFrame, Component, str], DataFrame]
    defaults: tuple[str, ...] = ()
    create: Callable[[list[Component]], dict] = lambda pipeline: {}
    reset: Callable[[dict], dict] = lambda state: {}


_LIBRARIES: dict[str, Library] = {}
_DEFAULT: list[Context] = []
_BOUND: ContextVar[Context | None] = ContextVar("lexigrove_context", default=None)

#: Components in the order in which each finds what it needs.
ORDER = ("tokenize", "sents", "pos", "morph", "stopword", "ner", "tok-re", "parse-tree", "dependency-parse-tree", "natlog", "sentiment", "coref", "srl")


def register_library(library: Library, force: bool = False) -> None:
    """Makes a library known. The default context is made anew if the library is new or ``force`` is given."""
    if library.name not in _LIBRARIES or force:
        _LIBRARIES[library.name] = library
        _DEFAULT.clear()


def unregister_library(name: str) -> None:
    if _LIBRARIES.pop(name, None):
        _DEFAULT.clear()


def libraries() -> dict[str, Library]:
    return dict(_LIBRARIES)


def all_parsers() -> list[str]:
    return [x for x in _LIBRARIES if _LIBRARIES[x].defaults]


def registered_components() -> dict[str, Callable[..., Component]]:
    return {name: f for library in _LIBRARIES.values() for name, f in library.constructors.items()}


def registered_namespaces() -> list[str]:
    """The names of libraries, each once: what may stand before a slash in a configuration string."""
    return list(dict.fromkeys(_LIBRARIES))


def components_as_string() -> str:
    return ",".join(sorted(registered_components()))


def component_documentation() -> list[tuple[str, str]]:
    return [(name, " ".join((f.__doc__ or "").split())) for name, f in sorted(registered_components().items())]


def component_documentation_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(component_documentation(), "name string, doc string")


def print_component_documentation() -> None:
    for name, doc in component_documentation():
        print(f"{name}\n  {doc}")


def components_by_parsers(parsers: list[str]) -> list[Component]:
    """All components without arguments of some libraries, in the order in which they can run."""
    made = [_LIBRARIES[p].constructors[name]() for p in parsers for name in _LIBRARIES[p].defaults]
    return sorted(made, key=lambda x: ORDER.index(x.component) if x.component in ORDER else len(ORDER))


def create_parse_config(pipeline: list | None = None, only_tokenize: bool = False, parsers: list[str] | None = None) -> list:
    """A list of components (or functions of DataFrames): ``pipeline`` if given, else tokens and sentences, else libraries' own."""
    if pipeline is not None:
        return list(pipeline)
    if only_tokenize:
        return [c.tokenize(), c.sentence()]
    return components_by_parsers(all_parsers() if parsers is None else parsers)


@dataclass
class Context:
    """A configuration with its time limit and what libraries keep for it."""

    config: list
    timeout_millis: int | None = None
    state: dict[str, dict] = field(default_factory=dict)


def create_context(config: list | str | None = None, timeout_millis: int | None = None, **options: Any) -> Context:
    """From a configuration, a configuration string, or the options of :func:`create_parse_config`."""
    if isinstance(config, str):
        from lexigrove.plans.dsl import parse

        config = create_parse_config(pipeline=parse(config))
    elif config is None:
        config = create_parse_config(**options)
    own = [x for x in config if isinstance(x, Component)]
    return Context(config, timeout_millis, {name: library.create([x for x in own if x.parser == name]) for name, library in _LIBRARIES.items()})


def current_context() -> Context:
    """The bound context, else the default one, which is made when it is first needed."""
    bound = _BOUND.get()
    if bound is not None:
        return bound
    if not _DEFAULT:
        _DEFAULT.append(create_context())
    return _DEFAULT[0]


@contextmanager
def with_context(context: Context) -> Iterator[Context]:
    token = _BOUND.set(context)
    try:
        yield context
    finally:
        _BOUND.reset(token)


def reset(hard: bool = True) -> None:
    """Clears what libraries keep; with ``hard`` the default context too."""
    context = _BOUND.get() or (_DEFAULT[0] if _DEFAULT else None)
    if context is not None:
        for name, library in _LIBRARIES.items():
            context.state[name] = library.reset(context.state.get(name, {}))
    if hard:
        _DEFAULT.clear()


def component_from_config(config: list, name: str) -> Component | None:
    return next((x for x in config if isinstance(x, Component) and x.component == name), None)


def component_from_context(context: Context, name: str) -> Component | None:
    return component_from_config(context.config, name)


def distinct_parsers(config: list) -> list[str]:
    """Libraries of a configuration, in order, each once; components of unknown libraries are warned of and left out."""
    found = list(dict.fromkeys(x.parser for x in config if isinstance(x, Component)))
    for name in found:
        if name not in _LIBRARIES:
            log.warning("no library is called %s", name)
    return [x for x in found if x in _LIBRARIES]


def annotate(df: DataFrame, text_col: str = "text", context: Context | None = None) -> DataFrame:
    """``df`` with the columns of the context's pipeline: a lazy plan, components in the listed order.

    Filters on annotations run on what the plan gives, not once more on the texts; filter on the table's own columns before.
    """
    context, own = context or current_context(), df.columns
    known = set(distinct_parsers(context.config))
    for x in context.config:
        if callable(x):
            df = x(df)
        elif x.parser in known:
            df = _LIBRARIES[x.parser].run(df, x, text_col)
    if chains.steps(df):  # what a chain gives is settled
        return df
    return df.withColumns({name: settled(F.col(name)) for name in df.columns if name not in own})


class ParseTimeoutError(TimeoutError):
    """An action on annotations took longer than its context allows."""


def run_within(spark: SparkSession, millis: int | None, action: Callable[[], Any]) -> Any:
    """An action's result; after ``millis`` its jobs are cancelled and :class:`ParseTimeoutError` is raised."""
    if millis is None:
        return action()
    tag = f"lexigrove-{threading.get_ident()}-{id(action)}"
    late = threading.Event()

    def stop() -> None:
        late.set()
        for _ in range(40):  # until the job that is being prepared has begun, too
            spark.interruptTag(tag)
            if done.wait(0.25):
                return

    done = threading.Event()
    timer = threading.Timer(millis / 1000, stop)
    spark.addTag(tag)
    timer.start()
    try:
        result = action()
    except Exception as e:
        if late.is_set():
            raise ParseTimeoutError(f"not done after {millis} ms") from e
        raise
    finally:
        done.set()
        timer.cancel()
        spark.removeTag(tag)
    if late.is_set():
        raise ParseTimeoutError(f"not done after {millis} ms")
    return result


def parse(spark: SparkSession, utterance: str, context: Context | None = None):
    """One utterance's record as a row, within the context's time limit."""
    from lexigrove.plans.records import to_record
    from lexigrove.sources.utterances import utterances

    context = context or current_context()
    found = to_record(annotate(utterances(spark, [utterance]), context=context), "doc_id")
    return run_within(spark, context.timeout_millis, found.collect)[0]["panon"]


register_library(Library("rules", c.RULE_CONSTRUCTORS, c.run_rules, tuple(c.DEFAULT_RULES)))
register_library(Library("srl", c.ROLE_CONSTRUCTORS, c.run_roles, ("semantic-role-labeler",)))
