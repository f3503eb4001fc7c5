"""Typed relational queries that are checked when built and lowered to Spark DataFrames."""

from .extension import *  # noqa: F403
from .functions.comparison import *  # noqa: F403
from .functions.scalar import *  # noqa: F403
from .naming import snake_case, sql_names
from .nodes import Expr, Query, Source, is_column_reference, is_expression, omit, typed_value, value
from .operators.clauses import *  # noqa: F403
from .operators.mutation import *  # noqa: F403
from .operators.select import *  # noqa: F403
from .plans.engine import Adapter, DriverValueEncoder, Engine, execute, execute_query
from .render import *  # noqa: F403
from .schema import *  # noqa: F403
from .schema.databases import *  # noqa: F403
from .sources import *  # noqa: F403
from .types import CapabilityError, Domain, DomainError, GroupingError, QueryError, ScopeError, UnsupportedError

_OWN = (snake_case, sql_names, Expr, Query, Source, is_column_reference, is_expression, omit, typed_value, value, Adapter, DriverValueEncoder, Engine, execute, execute_query, CapabilityError, Domain, DomainError, GroupingError, QueryError, ScopeError, UnsupportedError)
