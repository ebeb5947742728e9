from keepsake import schema


def test_the_model_is_complete():
    assert len(schema.TABLES) == 34 and len(schema.EDGES) == 37 and len(schema.ENUMS) == 20
    assert {"note_checklists", "tag_synonyms"} <= set(schema.TABLES)
    assert [len(schema.ENUMS[k]) for k in ("LinkType", "EntityType", "MessageType", "EmailFolder", "Platform", "AccountType", "LocationType")] == [16, 12, 12, 9, 8, 9, 12]


def test_edges_and_enumerations_name_real_columns():
    for e in schema.EDGES:
        assert any(c.name == e.column for c in schema.columns(e.table)) and e.target in schema.TABLES
    for t in schema.TABLES:
        names = [c.name for c in schema.columns(t)]
        assert len(names) == len(set(names))
        for c in schema.columns(t):
            values = schema.enum_of(t, c.name)
            assert not (values and c.default) or c.default in values, (t, c.name)
    for key in schema.JSON:
        table, column = key.split(".")
        assert any(c.name == column for c in schema.columns(table))


def test_types_and_drift():
    own = {c.name: c for c in schema.columns("accounts")}
    assert own["account_number_last4"].kind == "string" and own["currency"].default == "USD"
    assert schema.schema("transactions")["amount"].dataType.simpleString() == "decimal(12,2)"
    assert {c.name: c.length for c in schema.columns("media_embeddings")}["embedding"] == 768
    assert [c.length for c in schema.columns("face_encodings") if c.length] == [128]
    assert not next(c for c in schema.columns("tags") if c.name == "name").required
    assert [c.name for c in schema.columns("knowledge_notes") if c.required] == ["id", "created_at", "updated_at", "content"]
    assert schema.enum_of("chat_threads", "source_type") is None and schema.enum_of("media", "source_type") == schema.ENUMS["SourceType"]
    assert schema.enum_of("entity_links", "source_type") == schema.ENUMS["EntityType"]
    assert schema.range_of("budgets", "month") == (1, 12) and schema.range_of("media", "latitude") == (-90, 90)
    assert len({schema.fingerprint(t) for t in schema.TABLES}) == 34


def test_empty_tables(spark):
    for t in ("people", "media_embeddings", "budgets"):
        assert schema.empty(spark, t).count() == 0 and schema.empty(spark, t).columns == [c.name for c in schema.columns(t)]
