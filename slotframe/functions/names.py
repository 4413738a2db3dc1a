"""Names of status codes, event kinds and catalog tags. Fixed values."""

from __future__ import annotations

#: Status codes in order from 0.
STATUS = (
    "kOk", "kPageIdInvalid", "kCacheSlotsFull", "kPrepareFailedLogClosed", "kPrepareFailedTrimRequired",
    "kCommitFailedLogClosed", "kFileLogEraseNotConfirmed", "kInvalidPageAllocatorProposal", "kRecyclerStopped",
    "kTooManyPendingBatchesDuringRecovery", "kInvalidBatchCommitDuringRecovery",
    "kBatchContainsUnknownPageDuringRecovery", "kRecoverFailedPageReallocated", "kNeedMoreDataToTrim",
    "kBreakSlotReaderLoop", "kSlotReaderOutOfData", "kDuplicatePrepareJob", "kBadPackedVariant",
    "kSlotGrantTooSmall", "kFailedToPackSlotVarHead", "kFailedToPackSlotVarTail", "kPageGenerationNotFound",
    "kFileLogDeviceConfigWriteFailed", "kFileLogDeviceConfigReadFailed", "kStorageObjectTypeError",
    "kTransferAllBadAlignment", "kPageCacheConfigFileBadMagic", "kFakeLogDeviceExpectedFailure",
    "kNoReaderForPageViewType", "kIoRingLogFlushOpExpectedFailure", "kFilesystemPageWriteFailed",
    "kFilesystemPageOpenFailed", "kFilesystemPageReadFailed", "kFilesystemRemoveFailed", "kPinFailedPageEvicted",
    "kPageViewUserDataAlreadyInitialized", "kRecoverFailedGenerationZero", "kUnpackCastWrongIntegerSize",
    "kUnpackCastNullptr", "kUnpackCastVariantStructOutOfBounds", "kUnpackCastIntegerOutOfBounds",
    "kUnpackCastPackedBytesStructUnder", "kUnpackCastPackedBytesStructOver", "kUnpackCastPackedBytesDataUnder",
    "kUnpackCastPackedBytesDataOver", "kUnpackCastStructUnder", "kUnpackCastStructOver", "kPageHeaderBadMagic",
    "kPageHeaderBadPageId", "kPageHeaderBadPageSize", "kPageHeaderBadUnusedSize", "kPageHeaderBadUnusedBegin",
    "kPageHeaderBadUnusedEnd", "kPageHeaderBadGeneration", "kLogBlockBadMagic", "kLogBlockCommitSizeOverflow",
    "kStorageFileBadConfigBlockMagic", "kStorageFileBadConfigBlockCrc", "kOutOfAttachments",
    "kPageAllocatorNotAttached", "kPageReaderConflict", "kPageHeaderBadLayoutId", "kPutViewUnknownLayoutId",
    "kPageCacheSlotNotInitialized", "kIoRingShutDown", "kLogControlBlockBadMagic", "kLogDeviceV1Deprecated",
    "kStorageObjectNotLastInFile",
)

#: Kinds of volume events in order of their tags.
EVENT_KINDS = ("ids", "attach", "detach", "recovered", "prepare", "commit", "rollback", "upgrade", "raw", "trim")

#: Catalog tags that have a name; all others are UNKNOWN.
TAGS = {
    0: "kNone",
    1: "kPageArena",
    2: "kVolume",
    3: "kLogDevice",
    4: "kPageDevice",
    5: "kPageAllocator",
    0x1000: "kVolumeContinuation",
}
PAGE_MAGIC = 0x35F2E78C6A06FC2B
