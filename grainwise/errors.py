"""Named refusals: each is raised before any Spark job starts."""


class SemanticError(Exception):
    """Anything this engine refuses; the subclass names the reason."""


def _kind(name: str, doc: str) -> type[SemanticError]:
    return type(name, (SemanticError,), {"__doc__": doc, "__module__": __name__})


EmptyRequest = _kind("EmptyRequest", "Neither dimensions nor metrics nor facts were asked for.")
UnknownView = _kind("UnknownView", "No view of that name can be seen.")
AmbiguousView = _kind("AmbiguousView", "Several schemas hold a view of that name.")
UnknownDimension = _kind("UnknownDimension", "No such dimension.")
UnknownMetric = _kind("UnknownMetric", "No such metric.")
UnknownFact = _kind("UnknownFact", "No such fact.")
DuplicateMember = _kind("DuplicateMember", "A member was asked for twice.")
PrivateMember = _kind("PrivateMember", "A private metric or fact was asked for.")
FactsMetricsExclusion = _kind("FactsMetricsExclusion", "Facts and metrics can't be asked for together.")
FanTrap = _kind("FanTrap", "A dimension lies below a metric's grain.")
RootGrainFanTrap = _kind("RootGrainFanTrap", "A metric above the base table would be repeated for each of its rows.")
MetricFanTrap = _kind("MetricFanTrap", "Metrics of different grains would inflate each other, and can't be asked apart.")
WhereFanTrap = _kind("WhereFanTrap", "A filter member lies below a metric's grain.")
FactFanTrap = _kind("FactFanTrap", "A member reaches a fact on a table that fans.")
FactPathViolation = _kind("FactPathViolation", "Row-level members lie on tables without a common row.")
WhereReferencesMetric = _kind("WhereReferencesMetric", "A filter names a metric; it runs before aggregation.")
AmbiguousPath = _kind("AmbiguousPath", "Several relationships lead to a member's table.")
WindowAggregateMixing = _kind("WindowAggregateMixing", "Window and aggregate metrics can't be asked for together.")
WindowRequiredDimension = _kind("WindowRequiredDimension", "A window metric needs a dimension that was not asked for.")
SemiAdditiveUnsupported = _kind("SemiAdditiveUnsupported", "A metric can't be computed over a snapshot.")
SemiAdditiveDependency = _kind("SemiAdditiveDependency", "A metric depends on a metric that is a snapshot here.")
CountStarRequiresKey = _kind("CountStarRequiresKey", "Rows of a joined table without a primary key can't be counted.")
DefinitionError = _kind("DefinitionError", "A definition contradicts itself.")
CycleError = _kind("CycleError", "Definitions or relationships form a cycle.")
ParseError = _kind("ParseError", "A statement does not follow the grammar.")
