from tessera.functions.rand import keyed_uniform, weighted_choice  # noqa: F401
from tessera.functions.text import (  # noqa: F401
    PY_WHITESPACE,
    count_sub,
    lstrip_chars,
    py_strip,
    rstrip_chars,
    strip_chars,
)
