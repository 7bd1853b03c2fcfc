from braidlake.functions import codec, naming

import pytest

from braidlake.errors import RequestError


@pytest.mark.parametrize(("function", "given", "wanted"), [
    (naming.camel, "block_number", "blockNumber"), (naming.camel, "_global", "_global"), (naming.camel, "id", "id"),
    (naming.pascal, "volume_u_s_d", "VolumeUSD"), (naming.pascal, "_global", "_Global"),
    (naming.plural, "category", "categories"), (naming.plural, "address", "addresses"), (naming.plural, "day", "days"), (naming.plural, "status_metadatum", "status_metadata"),
    (naming.singular, "categories", "category"), (naming.singular, "buses", "bus"), (naming.singular, "responses", "response"), (naming.singular, "churches", "church"),
    (naming.singular, "boxes", "box"), (naming.singular, "glass", "glass"), (naming.singular, "metadata", "metadatum"),
    (naming.type_name, "block_extrinsics", "BlockExtrinsic"), (naming.plural_type_name, "volume_u_s_ds", "VolumeUsds"), (naming.plural_type_name, "order_v2s", "OrderV2s"),
    (naming.plural_type_name, "_global", "_Globals"), (naming.plural_type_name, "accumulated_fees", "AccumulatedFees"),
    (naming.connection_field, "order_v2s", "orderV2s"), (naming.single_field, "accounts", "account"),
    (naming.forward_field, "creator_id", "creator"), (naming.forward_field, "owner_uuid", "owner"), (naming.forward_field, "plain", "plain"),
    (naming.enum_type, "869e90c211", "_869E90C211"), (naming.enum_type, "1c84cbf86c", "_1C84Cbf86C"), (naming.enum_type, "order_status", "OrderStatus"),
])
def test_names(function, given, wanted):
    assert function(given) == wanted


def test_backward_fields():
    assert naming.backward_field("transfers", "account_id") == "transfersByAccountId"
    assert naming.backward_single_field("profiles", "author_id") == "profileByAuthorId"


def test_codec():
    assert codec.decode(codec.encode({"a": 1, "é": None}), dict) == {"a": 1, "é": None}
    for bad in ("?", "bm90IGpzb24=", codec.encode([1])):
        with pytest.raises(RequestError):
            codec.decode(bad, dict)
