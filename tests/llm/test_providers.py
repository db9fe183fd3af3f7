from siftlake.llm.names import provider, same_provider


def test_all_words_of_a_provider_count():
    same = lambda a, b: same_provider(provider(a), provider(b))
    assert not same("Anand Kala Vikas Charitable Trust", "Anand Kala Seva Charitable Trust")
    assert same("Anand Kala Vikas Charitable Trust, Pune", "Anand Kala Viaks Char. Trust (Delhi)")
    assert same("A. K. Vikas Charitable Trust", "Anand Kala Vikas Charitable Trust")
    assert same("AKVCT", "Anand Kala Vikas Charitable Trust")


def test_places_are_dropped_by_position():
    assert provider("Vojaja University, Jolonu") == provider("Vojaja University")
    assert provider("Vojaja Jolonu University, Nonu") == provider("Vojaja Jolonu University Nonu") == provider("Vojaja Jolonu University (Nonu)") == provider("Vojaja Jolonu University")
    assert provider("Jolonu, Vojaja Univ., Nonu").name == ("jolonu", "vojaja")
    assert provider("University of Vojaja Jolonu, Nonu").name == provider("University, Vojaja Jolonu").name == provider("University, Vojaja, Jolonu").name == ("vojaja", "jolonu")
    assert provider("Vojaja Jolonu Foundation, Nonu") == provider("Vojaja Jolonu Foundation")
    assert same_provider(provider("Vojaja Jolonu Cahrtiabel Trutt"), provider("Vojaja Jolonu Charitable Trust"))
