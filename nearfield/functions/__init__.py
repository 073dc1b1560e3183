from nearfield.functions import scalars, vectors  # noqa: F401
from nearfield.functions.vectors import (  # noqa: F401
    cosine,
    dot,
    inner_product,
    l2_distance,
    l2_normalize,
    norm,
    sq_l2,
)
