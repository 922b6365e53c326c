"""Steps by name and workflows by document type: chains of DataFrame -> DataFrame functions."""

from __future__ import annotations

import json
import logging
from collections.abc import Callable

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame

from docloom.functions.ports import PortError
from docloom.sources.settings import interpolate

log = logging.getLogger(__name__)

Step = Callable[[DataFrame], DataFrame]
STEPS: dict[str, Step] = {}
#: Steps that only improve a document: without them it still goes in.
OPTIONAL = {"enrich", "embed", "quality_parse", "region_enhance", "vlm_caption", "verify"}
#: The order of steps by workflow.
DEFAULT = ("detect_format", "parse", "outline", "chunk", "enrich", "embed", "write", "verify", "finalize")
WORKFLOWS: dict[str, tuple[str, ...]] = {"default": DEFAULT, "md": DEFAULT, "txt": DEFAULT, "html": DEFAULT}


def step(name: str):
    """Register a step under a name."""

    def put(f: Step) -> Step:
        STEPS[name] = f
        return f

    return put


def chain(names: tuple[str, ...], steps: dict[str, Step] | None = None) -> list[tuple[str, Step]]:
    """The named steps in order; KeyError for a name that is not registered."""
    steps = STEPS if steps is None else steps
    missing = [n for n in names if n not in steps]
    if missing:
        raise KeyError(f"steps not registered: {', '.join(missing)}; there are {', '.join(sorted(steps))}")
    return [(n, steps[n]) for n in names]


def load(path: str, steps: dict[str, Step] | None = None) -> dict[str, tuple[str, ...]]:
    """Workflows of a JSON file (document type to list of steps, with variables as in settings); KeyError for an unregistered step."""
    with open(path, encoding="utf-8") as f:
        tree = json.loads(interpolate(f.read()))
    for names in tree.values():
        chain(tuple(names), steps)
    return {kind: tuple(names) for kind, names in tree.items()}


def run(df: DataFrame, workflow: str = "default", steps: dict[str, Step] | None = None, workflows: dict[str, tuple[str, ...]] | None = None) -> tuple[DataFrame, list[str]]:
    """df through a workflow's steps (an unknown workflow is the default one), and warnings.

    Steps are plans; one that Spark cannot plan or whose port does not answer is passed over if it is optional, with a warning, and
    raised otherwise. Mistakes in a step's code are raised. Nothing is computed here.
    """
    warnings = []
    known = WORKFLOWS if workflows is None else workflows
    for name, f in chain(known.get(workflow, known["default"]), steps):
        try:
            df = f(df)
        except (PySparkException, PortError) as e:
            if name not in OPTIONAL:
                raise RuntimeError(f"step {name}: {e}") from e
            log.warning("step %s passed over: %s", name, e)
            warnings.append(f"{name}: {e}")
    return df, warnings
