"""Import every catalog module so their queries register themselves."""

from quarry.plans import catalog, catalog_batch, catalog_learn, catalog_models, catalog_prep, catalog_space, catalog_strata  # noqa: F401
from quarry.plans.registry import ORACLE, REGISTRY  # noqa: F401
