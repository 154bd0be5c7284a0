"""What can go wrong, one class each. ``error_class`` is the stable name of the condition."""


class ArchiveError(Exception):
    """Base of all errors of this engine."""

    @property
    def error_class(self) -> str:
        return type(self).__name__


def _error(name: str, says: str, base: type = ArchiveError) -> type:
    return type(name, (base,), {"__doc__": says, "__module__": __name__})


InvalidMagicNumber = _error("InvalidMagicNumber", "The file does not begin with the format's magic bytes.")
UnsupportedVersion = _error("UnsupportedVersion", "The file is of this format, but of a version that is not supported.")
InvalidCompression = _error("InvalidCompression", "A compression code is not one of 0 to 4.")
UnsupportedCompression = _error("UnsupportedCompression", "The compression is unknown or its module is not installed.")
InvalidEntry = _error("InvalidEntry", "A directory does not decode.")
InvalidHeader = _error("InvalidHeader", "The header is too short or points outside what it may.")
InvalidMetadata = _error("InvalidMetadata", "The metadata is no JSON object of the expected form.")
IndexEntryOverflow = _error("IndexEntryOverflow", "A length does not fit 32 bits.")
InvalidMetadataUtf8Encoding = _error("InvalidMetadataUtf8Encoding", "The metadata is not UTF-8.")
InvalidTileType = _error("InvalidTileType", "A tile type code is not one of 0 to 6.")
ReadingError = _error("ReadingError", "Bytes could not be read.")
UnableToOpenFile = _error("UnableToOpenFile", "The file could not be opened.", ReadingError)
UnexpectedNumberOfBytesReturned = _error("UnexpectedNumberOfBytesReturned", "A read gave fewer bytes than were asked for.", ReadingError)
RangeRequestsUnsupported = _error("RangeRequestsUnsupported", "The server does not answer range requests with status 206.", ReadingError)
ResponseBodyTooLong = _error("ResponseBodyTooLong", "The server sent more bytes than were asked for.", ReadingError)
HttpError = _error("HttpError", "The server answered with an error.", ReadingError)
InvalidHeaderValue = _error("InvalidHeaderValue", "A request header has characters that it may not have.", ReadingError)
S3Error = _error("S3Error", "The S3 store failed.", ReadingError)
ObjectStoreError = _error("ObjectStoreError", "The object store failed.", ReadingError)
SourceModified = _error("SourceModified", "The source changed after it was opened.")
InvalidCoordinate = _error("InvalidCoordinate", "z, x, y is no tile coordinate.")
InvalidTileId = _error("InvalidTileId", "The number is no tile id.")
DirectoryCacheError = _error("DirectoryCacheError", "A cached directory could not be fetched.")
