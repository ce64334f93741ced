"""Errors of the engine. A missing key is none of them: it is None or an empty result."""


class KeyloomError(Exception):
    """Base of all errors here."""


class BucketNotFound(KeyloomError):
    pass


class BucketAlreadyExists(KeyloomError):
    pass


class InvalidBucketName(KeyloomError):
    pass


class KeyNotFound(KeyloomError):
    pass


class InvalidKey(KeyloomError):
    """A key or value over the size limits."""


class OptionMismatch(KeyloomError):
    """An option differs from what the store was made with."""


class PageSizeMismatch(OptionMismatch):
    pass


class Corrupted(KeyloomError):
    pass


class InvalidManifest(Corrupted):
    """One manifest cannot be read or fails its checksum."""


class NoValidManifest(InvalidManifest):
    """No manifest of the store is valid."""


class TxClosed(KeyloomError):
    """Use of a transaction after commit or rollback."""


class TxCommitFailed(KeyloomError):
    pass


class WalCorrupted(KeyloomError):
    pass


class WalRecordInvalid(KeyloomError):
    pass


class CheckpointFailed(KeyloomError):
    pass


class GroupCommitFailed(KeyloomError):
    pass
