"""What a request can fail with, and the HTTP code that each failure stands for."""


class CohortError(Exception):
    code = 500


class BadRequest(CohortError):
    code = 400


class FilterError(BadRequest):
    pass


class BadUserInput(CohortError):
    code = 460


class InsufficientDataError(CohortError):
    code = 461

    def __init__(self, message: str = "The algorithm could not run with the input provided because there are insufficient data."):
        super().__init__(message)


class SMPCUsageError(CohortError):
    code = 462


class UnresponsiveError(CohortError):
    code = 512


class TaskTimeoutError(CohortError):
    code = 513


def status_of(error: Exception) -> int:
    return error.code if isinstance(error, CohortError) else 500
