"""One exception per family of operators; messages name the column or setting at fault."""


class TidemarkError(ValueError):
    """Any input or setting that an operator refuses."""


class ConfigError(TidemarkError):
    pass


class TimeAxisError(TidemarkError):
    pass


class FeatureError(TidemarkError):
    pass


class LeakageError(TidemarkError):
    pass


class GapError(TidemarkError):
    pass


class ModelError(TidemarkError):
    pass


class InsufficientTrainingData(ModelError):
    """Carries the fit report as report."""

    def __init__(self, message: str, report=None):
        super().__init__(message)
        self.report = report


class FillError(TidemarkError):
    pass


class MetricError(TidemarkError):
    pass


class ReportError(TidemarkError):
    pass


class SourceError(TidemarkError):
    pass


class ProvenanceError(TidemarkError):
    """A manifest that lacks a part, or counts that contradict each other."""


class ValidationWarning(UserWarning):
    """A run withheld rows but could score none of them."""


class ModelWarning(UserWarning):
    """A stored model was made under other versions or settings."""


class GapWarning(UserWarning):
    """The gap scenario missed what was asked of it."""


class LeakageWarning(UserWarning):
    """A feature mode that is known to leak withheld values."""


class ReportWarning(UserWarning):
    """A report lacks something that it does not need."""
