"""Connected components, as the library's gate finds them too."""

from ..operators.components import connected, connected_further, rooted  # noqa: F401
